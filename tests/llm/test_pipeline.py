import corpus_pipeline as cp
from specloom.llm import language
from specloom.llm.common import settle

from .test_dedup import brute_components
from .util import documents, odd, shingles, words


def test_stages_take_effect(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bench = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before, docs = docs.collect(), settle(stage(spark, docs, sf_dir), "stage")
        after = docs.collect()
        kept = {r.doc_id for r in after}
        if name == "language ID":
            assert kept == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
            assert {r.doc_id: r.lang for r in after} == {r.doc_id: r.lang_pred for r in language.op7_language(spark, sf_dir).collect() if r.doc_id in kept}
            assert all(r.lang for r in after)
        elif name == "near duplicates":
            assert kept == {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in before]).items() if i == c}
        elif name == "repeated passages":
            assert all(len(r.text) == r.n_chars for r in after) and sum(len(r.text) for r in after) < sum(len(r.text) for r in before)
        elif name == "benchmark decontamination":
            assert kept == {r.doc_id for r in before if not any(100 * len(b & shingles(r.text)) >= 75 * len(b) for b in bench)}
        else:
            assert {r.doc_id: r["size"] for r in after} == {r.doc_id: len(words(r.text)) for r in before}
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, after))


def test_stages_on_odd_rows(spark, sf_dir):
    for docs in (odd(spark), odd(spark).limit(0)):
        for _, stage in cp.STAGES:
            docs = settle(stage(spark, docs, sf_dir), "stage")
            docs.count()


def test_language_stage_rejects_unlearned_scripts(spark, sf_dir):
    rows = [(i, "the house is on the hill by the sea", "en", "s", 9) for i in range(8)] + [(20, "ฉันรักคุณ มาก", None, "s", 9), (21, "12 34", "en", "s", 9), (22, "a hill by the sea ฉันรักคุณ", None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.lang for r in cp.language_id(spark, docs, sf_dir).collect()} == {i: "en" for i in [*range(8), 22]}


def test_repeated_ids_keep_the_smallest_row(spark, sf_dir):
    """The same rows stay however they are dealt."""
    rows = [(5, f"{w} text of its own that shares no words with {w}{w} or any other row here {w}x", lang, "s", 9) for w, lang in (("pear", "en"), ("apple", "fr"), ("apple", "de"), ("fig", None))] + [(5, None, "en", "s", 9), (6, "zebra", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(map(str, cp.near_duplicates(spark, docs.repartition(k), sf_dir).collect())) for k in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 2 and "text=None" in got[0][0]
