import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from specloom.llm import common, decontamination, language, quality
from tests.oracle import same

from .util import ODD, documents, odd, rest, shingles


def test_containment_equals_sql(spark, sf_dir):
    same(decontamination.op1_decontamination(spark, sf_dir), decontamination.ORACLE, sf_dir)


def test_short_items_in_long_documents(spark):
    item = [f"k{i}" for i in range(40)]
    noise = [f"n{i}" for i in range(15_000)]
    rows = [(0, " ".join(noise + item + noise)), (1, " ".join(noise[:50] + item[:30])), (2, " ".join(item[:38] + noise[:9])), (3, " ".join(item).upper()), (4, "a b"), (5, None), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(0, " ".join(item)), (1, "a b"), (2, None), (3, ""), (0, " ".join(item))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i, len(shingles(t)), len(shingles(t) & shingles(x))) for d, x in rows for i, t in items if shingles(t) and 100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(t))}
    for most in (1_000_000, 0):  # broadcast, and shuffled
        got = decontamination.contained(docs, bench, broadcast_rows=most, broadcast_bytes=most)
        assert sorted([tuple(r)[1:5] for r in got.collect()], key=str) == sorted(want, key=str)
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {1, 5}


def test_containment_odd_rows(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    clean = decontamination.decontaminate(odd(spark), bench)
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([2, 3, 4, 5, None, 7, 8], key=str) and clean.columns == odd(spark).columns
    assert decontamination.contained(odd(spark).limit(0), bench).count() == 0 and decontamination.contained(odd(spark), bench.limit(0)).count() == 0


def test_languages_of_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in documents(spark, sf_dir).collect()}
    got = language.op7_language(spark, sf_dir).collect()
    assert len(got) == len(langs) and all(r.held_out == (rest(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def test_spans_of_mixed_text(spark):
    train = spark.createDataFrame([("the house and the garden of the king with this thing " * 5, "en"), ("la maison et le jardin du roi avec cette chose été " * 5, "fr"), ("дом и сад короля с этой вещью " * 5, "ru")], "text string, lang string")
    model = language.learn(train)
    text = "the king and the house with the garden la maison et le jardin avec cette chose дом короля и сад"
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, penalty=2.0).first()
    assert [s.lang for s in row.spans] == ["en", "fr", "ru"] and sum(s.words for s in row.spans) == len(text.split())


def test_ngrams_exist_for_a_block_at_a_time(monkeypatch):
    """Blocks of words change no count and no label, and a slice of 2 MB with new words only takes less than 40 bytes a byte beside Arrow's."""
    import tracemalloc

    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdeéжж1")) for _ in range(rng.integers(1, 9)))
    texts = pa.array([" ".join(word() for _ in range(rng.integers(0, 30))) for _ in range(60)] + [None, "", "12 %", "z" * 3000])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([["en", "ru", "fr"][i % 3] for i in range(len(texts))])], ["text", "lang"])
    model = {"langs": ["en", "ru"], "logp": rng.normal(size=(2, language.BUCKETS)).astype(np.float32), "allowed": np.ones((2, len(language.NAMES)), bool)}
    got = []
    for size in (1 << 30, 50, 1):
        monkeypatch.setattr(language, "BLOCK", size)
        grams = {}
        language.count_grams(batch, grams)
        lang, score, spans = language.label_texts(texts, model, 2.0)
        got.append(({k: v.tolist() for k, v in grams.items()}, lang, score.tolist(), spans))
    assert got[0] == got[1] == got[2] and {None, "en", "ru"} == set(got[0][1])
    monkeypatch.undo()
    big = pa.array(["".join(map(chr, x)) for x in np.where(rng.random((200, 10_000)) < 0.125, 32, rng.integers(97, 123, (200, 10_000)))])
    tracemalloc.start()
    language.label_texts(big, model, 2.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 21, most


def test_batches_are_bounded_in_bytes(spark):
    """A partition of 12 MB comes to Python in batches of about 2 MB, and a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        model = language.learn(spark.createDataFrame([("the house on the hill", "en")], "text string, lang string"))

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        texts = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "repeat('the house ', 1000) AS text")
        assert language.identify(texts, model, with_spans=False).where("lang_pred = 'en'").count() == 1200
        got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert len(got) >= 5 and max(got) < 3 << 20
        spark.conf.set(key, "64m")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_marks_alone_are_no_letters(spark):
    model = language.learn(spark.createDataFrame([("the house on the hill", "en")], "text string, lang string"))
    docs = spark.createDataFrame([(1, "\u0301\u0302 \u0301"), (2, "e\u0301t"), (3, "ฉันรัก"), (4, "12 %")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got == {1: ("und", 0.0), 2: ("en", 1.0), 3: ("en", 0.0), 4: ("und", 0.0)}


def test_paths_are_the_best_of_all():
    """Viterbi against every labelling of short texts."""
    rng = np.random.default_rng(4)
    scores, codes, starts = rng.normal(size=(7, 3)), rng.integers(0, 7, 16), np.array([0, 5, 5, 10, 16])
    got = language._paths(scores, codes, starts, 0.7)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        value = lambda path, own=codes[a:b]: sum(scores[c, x] for c, x in zip(own, path, strict=True)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        assert value(got[a:b]) == max(value(p) for p in itertools.product(range(3), repeat=b - a))


def test_language_odd_rows(spark):
    docs = odd(spark)
    got = language.identify(docs, language.learn(docs)).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4} and all(isinstance(r.score, float) for r in got)
    empty = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"} and language.identify(docs.limit(0), empty).count() == 0


def test_quality_of_held_out_documents(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.op3_quality(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (rest(r.doc_id, 3) == 1) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]) > 0.9


def test_quality_features_equal_plain_counts():
    texts = ["The cat, the CAT sat.\nThe cat, the CAT sat.\n", "a a a b", "Été 42!! NASA x_y", "", "  \n ", "one"]

    def plain(t):
        raw, words, lines = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        n, share = max(len(words), 1), lambda test: sum(map(test, raw)) / max(len(raw), 1)
        most = lambda x: max(Counter(x).values(), default=0)
        return {
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / n, "upper": share(lambda b: 65 <= b <= 90), "lower": share(lambda b: 97 <= b <= 122),
            "digit": share(lambda b: 48 <= b <= 57), "beyond_ascii": share(lambda b: b > 127), "line_ends": share(lambda b: b == 10), "distinct_words": len(set(low)) / n, "top_word": most(low) / n,
            "same_as_before": sum(a == b for a, b in itertools.pairwise(low)) / n, "short_words": sum(len(w.encode()) <= 3 for w in words) / n, "capital_words": sum(bool(re.match("[A-Z]{2,}", w)) and len(w.encode()) > 2 for w in words) / n,
            "top_line": most(lines) / len(lines) * (len(lines) > 1), "distinct_bigrams": len(set(itertools.pairwise(low))) / n, "words_per_line": len(words) / len(lines),
        }

    got = quality.features(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        for name, value in plain(t).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value if t else 0), (t, name)


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20, pairs=2)
    assert ((quality.predict(x, model) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_odd_rows(spark):
    f = quality.text_features(odd(spark)).collect()
    assert len(f) == len(ODD) and all(np.isfinite(r.features).all() for r in f) and not any(next(r for r in f if r.doc_id == 2).features)
    model = quality.learn(quality.text_features(odd(spark)).selectExpr("doc_id", "features", "cast(null as int) AS label"))
    assert {r.score for r in quality.score(quality.text_features(odd(spark)), model).collect()} == {0.5}
    assert quality.text_features(odd(spark).limit(0)).count() == 0


def test_slices_of_batches_split_like_whole_ones():
    texts = ["é à " * 50, None, "", " a  b\tC\n"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(common.pieces(batch, "text", 500))
    words = [w for p in parts for w in common.split_words(p.column("text"))[0].to_pylist()]
    assert len(parts) > 5 and words == [w for t in texts for w in common.split_words(pa.array([t]))[0].to_pylist()]
