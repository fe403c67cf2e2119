import importlib
import sys

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_removable_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("specloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "specloom.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert "transition_cpt" in entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
