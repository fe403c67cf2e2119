import itertools
import random
import re

from specloom.llm import filter_audit as fa
from tests.oracle import same

from .util import ODD, WORD, odd


def plain(text):
    w = WORD.findall(text)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


TEXTS = ["", " ", "a", "a a A", "été É#", " \t x\n\x0b y ", " b  ", "𝄞 𝄞$", "w" * 300, "ab " * 500, "ab cd " * 40 + "z" * 200 + " ab"]


def test_counts_in_blocks_of_any_size():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aB é\n#𝄞") for _ in range(rng.randrange(200))) for _ in range(60)]
    for block in (7, 64, 1 << 20):
        assert fa.read_texts([t.encode() for t in texts], block).tolist() == [plain(t) for t in texts]


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(fa, "codes", lambda data, start, end: (end - start).astype("uint64"))
    assert fa.read_texts([t.encode() for t in TEXTS]).tolist() == [plain(t) for t in TEXTS]
    assert fa.read_texts([TEXTS[-1].encode()], 50).tolist() == [plain(TEXTS[-1])]


def test_query_equals_sql(spark, sf_dir):
    same(fa.op12_filter_audit(spark, sf_dir), fa.ORACLE, sf_dir)


def brute(docs, labels):
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for d, text, part in docs:
        n, distinct, capitals, points, symbols = plain(text or "")
        again = d is not None and any(o is not None and o < d and (t or "") == (text or "") for o, t, _ in docs)
        fails = {x for x, y in zip("ABCDE", [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0, again], strict=True) if y}
        rows.append((part or "", fails, d in good and d is not None, d in bad and d is not None))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                mine = [r for r in rows if r[0] == part]
                now = [r for r in mine if x in r[1] and not r[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = (
                    sum(not r[1] & set(order[: k + 1]) for r in mine), len(now), sum(x in r[1] for r in mine) - len(now), sum(r[1] == {x} for r in mine), sum(r[2] for r in now), sum(r[3] for r in now),
                )
    return {k: (*v, sum(w[1] for (p, o, s), w in out.items() if p == k[0] and o[s - 1] == k[1][k[2] - 1])) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    extra = [(20, long, "en"), (21, long, "fr"), (21, long, "fr"), (19, long + " #", None), (None, long, "en"), (22, long.upper(), ""), (23, "one " * 250, "en")]
    rows = [(r[0], r[1], r[2]) for r in ODD] + extra
    marks = [(20, 1, 0), (20, 0, 1), (21, 1, 1), (None, 1, 1), (4, None, 1), (23, 1, None), (99, 1, 1)]
    docs = odd(spark).select("doc_id", "text", "lang", "score").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True).withColumnRenamed("lang", "part")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = fa.audit(fa.failures(fa.measure(docs), labels), "ABCDE").collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == brute(rows, marks)
    assert not fa.audit(fa.failures(fa.measure(docs.limit(0)), labels), "ABCDE").count()
