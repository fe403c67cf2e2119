import math
from collections import Counter

import numpy as np
import pytest

from specloom.llm import ann, class_lm, mixing, token_counts, warc
from specloom.llm.common import settle
from tests.oracle import same

from .util import ODD, documents, odd, rest, words


def base_scores(rows, train):
    toks = [(i, words(t) + ["\n"]) for i, t in rows]
    c = Counter(w for (_, x), on in zip(toks, train, strict=True) if on for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, x in toks]


def test_class_lm(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    want = {x[0]: x[1:] for x in base_scores(rows, [rest(i, 5) != 1 for i, _ in rows])}
    got = class_lm.op6_class_lm(spark, sf_dir).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_lm_is_a_distribution(spark):
    """Scores of all one-word texts, the unseen word among them, add up to one times the chance of an end after them."""
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate([("a b a c", False), ("a b", False), ("b d", False)] + [(w, True) for w in ["a", "b", "c", "d", "zz", ""]])], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in class_lm.score_texts(docs, share=2, classes=3).collect()}
    firsts = sum(10 ** got[i].score for i in range(3, 9))
    assert 0 < firsts < 1 and got[7].n_known == 1 and got[8].n_tokens == 1


def test_exchange_finds_classes():
    rng = np.random.default_rng(2)
    seq = [int(rng.integers(1, 6)) + 5 * (k % 2) for k in range(4000)]  # words 1-5 and 6-10 take turns
    pairs = Counter(zip(seq, seq[1:], strict=False))
    a, b, n = (np.array(x) for x in zip(*[(x, y, c) for (x, y), c in pairs.items()], strict=True))
    of = class_lm.exchange(a, b, n, 11, 3)
    assert len(set(of[1:6])) == len(set(of[6:11])) == 1 and of[1] != of[6]


def test_class_lm_is_the_same_for_any_batching(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(150).selectExpr("doc_id", "text", "doc_id % 5 = 1 AS held_out")
    one, *others = ({(r.doc_id, r.n_tokens): r.score for r in class_lm.score_texts(docs.repartition(k), share=20, classes=5, batch_bytes=b, per_part=p).collect()} for k, b, p in ((1, 1 << 30, 1 << 20), (3, 1 << 14, 1 << 10), (7, 1 << 12, 200)))
    assert all(one == pytest.approx(x, rel=1e-9) for x in others)


def _brute_scores(rows, share, classes, least_gain):
    """Scores of (id, text, held_out) rows by plain counts: seeds by ``exchange``, then rounds in which every word, later half of them, takes the class of highest likelihood, until
    two rounds in a row gain too little."""
    toks = [(i, words(t) + ["\n"], h) for i, t, h in rows]
    c, big = Counter(w for _, x, h in toks if not h for w in x), Counter()
    for _, x, h in toks:
        if not h:
            big.update(zip(["\n", *x[:-1]], x, strict=True))
    total, v = sum(c.values()), len(c)
    seeds = sorted([w for w in c if c[w] * share >= total or w == "\n"], key=lambda w: (w != "\n", -c[w], class_lm.word_hash(w)))
    classes = max(2, min(max(classes, math.ceil(v ** (1 / 3))), v))
    own = sorted((seeds.index(a), seeds.index(b), n) for (a, b), n in big.items() if a in seeds and b in seeds)
    of = dict(zip(seeds, class_lm.exchange(*(np.array(x) for x in zip(*own, strict=True)), len(seeds), classes).tolist(), strict=True))

    def table(kind):
        out = np.zeros((classes, classes))
        for (a, b), n in big.items():
            if a in kind and b in kind:
                out[kind[a], kind[b]] += n
        return out

    best, turn, small, steps = None, None, 0, 0
    while True:
        seen = table(of)
        now = class_lm._information(seen)
        gain = math.inf if best is None else (now - best[2]) / max(abs(class_lm._information_scale(seen)), 1.0)
        turn = None if best is None else 0 if turn is None else 1 - turn
        if gain > 0:
            best = (dict(of), seen, now)
        small = 0 if gain > 0 and gain >= least_gain else small + 1
        if small >= 2:
            break
        steps, known, of = steps + 1, best[0], {}
        for w in c:
            value = [-np.inf] + [class_lm._information(table(known | {w: k})) for k in range(1, classes)]
            top = int(np.argmax(value))
            linked = any(w in p and (p[0] in known or p[1] in known or p[0] == p[1]) for p in big)
            if w == "\n":
                of[w] = 0
            elif w in known:
                moves = turn is None or bool(class_lm.in_half(np.array([class_lm.word_hash(w)], np.uint64), turn)[0])
                of[w] = top if moves and linked and value[top] > value[known[w]] + 1e-9 else known[w]
            else:
                of[w] = top if linked else 1 + class_lm.word_hash(w) % (classes - 1)
    of, seen, _ = best
    assert steps > 1
    unseen = math.log10(0.5 / (total + 0.5 * (v + 1)))
    live = int((seen.sum(axis=0) > 0).sum())
    out = {}
    for i, x, _ in toks:
        value, before = 0.0, 0
        for w in x:
            if c[w]:
                k = of[w]
                value += math.log10((seen[before, k] + 0.5) / (seen[before].sum() + 0.5 * live)) + math.log10(c[w] / max(seen[:, k].sum(), 1)) + math.log10(max(1 - 10**unseen, 1e-12))
                before = k
            else:
                value += unseen
        out[i] = value
    return out


def test_class_lm_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"{'abc'[k % 3]}{int(rng.integers(0, 5)) ** 2 % 7}" for k in range(int(rng.integers(0, 14)))) for _ in range(40)]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)] + [(90, "zz a0 yy", True), (91, "zz zz", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    for share, least_gain in ((4096, 0.01), (12, 0.05)):
        got = {r.doc_id: r.score for r in class_lm.score_texts(docs, share=share, classes=4, least_gain=least_gain, per_part=4).collect()}
        assert got == pytest.approx(_brute_scores(rows, share, 4, least_gain), rel=1e-9)


def test_all_words_take_part_in_clustering(spark):
    """Only the end and two words are seeds; the other 60 take turns in two groups, which rounds over all bigrams find."""
    rng = np.random.default_rng(5)
    texts = [" ".join("a" if k % 6 == 0 else "b" if k % 6 == 3 else f"{'ab'[k % 2]}{int(rng.integers(0, 30))}" for k in range(60)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    encoded = settle(class_lm.encoded_batches(docs, 1 << 12), "encoded")
    vocabulary = settle(class_lm.vocabulary(encoded, 3), "vocabulary")
    seeds = class_lm.Seeds(vocabulary, 61 * 80, 20)
    assert len(seeds) == 3
    kinds, pairs = class_lm.clustered(encoded, vocabulary, seeds, np.array([0, 1, 2]), 3, 0.001)
    of = {r.part: class_lm._read(r.a, "<i2") for r in kinds.collect()}
    named = {int(h): int(k) for r in vocabulary.where("batch = -2").collect() for h, k in zip(class_lm._read(r.a, "<u8"), of[r.part], strict=True)}
    group = lambda x: {named[class_lm.word_hash(w)] for w in x}
    assert len(named) == 63 and group(["\n"]) == {0} and group(["a", *(f"a{i}" for i in range(30))]) == group(["a"]) != group(["b"]) == group(["b", *(f"b{i}" for i in range(30))])


def test_choices_equal_the_likelihood():
    """The chosen class is the one whose table of pairs has the highest likelihood, all words but one staying."""
    rng = np.random.default_rng(3)
    words, c = 12, 4
    big = rng.integers(0, 6, (words, words)).astype(float)
    of = np.array([0, *rng.integers(1, c, words - 1)])

    def table(kind):
        out = np.zeros((c, c))
        np.add.at(out, (kind[:, None].repeat(words, 1), kind[None].repeat(words, 0)), big)
        return out

    rows = Counter()
    for a in range(words):
        for b in range(words):
            if a == b:
                rows[a, 2 * c] += big[a, b]
            else:
                rows[a, of[b]] += big[a, b]
                rows[b, c + of[a]] += big[a, b]
    word, code, n = (np.array(x) for x in zip(*[(w, k, v) for (w, k), v in sorted(rows.items()) if v], strict=True))
    got = class_lm.choices(of, word.astype(int), code.astype(int), n, table(of))
    for w in range(1, words):
        value = [class_lm._information(table(np.where(np.arange(words) == w, k, of))) for k in range(1, c)]
        assert value[got[w] - 1] == pytest.approx(max(value))


def test_base_scores_need_no_classes(spark, monkeypatch):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    rows = [(i, " ".join(f"w{(i * k * k) % 37}" for k in range(i % 9)), i % 5 == 1) for i in range(60)] + [(None, None, None), (70, "", False), (3, "A b  c", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    rows_of = lambda t: sorted(map(tuple, t.select(columns).collect()), key=str)
    want = rows_of(class_lm.score_texts(docs, share=20, classes=4))
    none = rows_of(class_lm.score_texts(docs.limit(0)))
    monkeypatch.setattr(class_lm, "clustered", None)
    assert rows_of(class_lm.base_scores(docs)) == want == rows_of(class_lm.base_scores(docs.repartition(3), batch_bytes=64, per_part=7))
    assert rows_of(class_lm.base_scores(docs.limit(0))) == none == []


def test_class_lm_odd_rows(spark):
    docs = odd(spark).drop("held_out").selectExpr("*", "doc_id IN (5, 6) AS held_out")
    got = class_lm.score_texts(docs).collect()
    want = base_scores([(r[0], r[1]) for r in ODD], [r[0] not in (5, 6) for r in ODD])
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == sorted([(*x[:4], round(x[4], 6)) for x in want], key=str)
    none = class_lm.score_texts(docs.withColumn("held_out", docs.doc_id.isNotNull() | docs.doc_id.isNull())).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert class_lm.score_texts(docs.limit(0)).count() == 0


def fill(sizes, weights, total, most):
    """Targets by sharing again and again."""
    target, goal, open_ = {}, total * sum(sizes.values()), set(sizes)
    while open_:
        share = {s: (goal - sum(target.values())) * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    sizes = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in got)
    of = {}
    for r in got:
        of[r.source] = of.get(r.source, 0) + r["size"]
    want = fill(of, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(of))}, 1.5, 2)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in of}
    for r in got:
        assert r.source_size == of[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= 0.05 * r.target + 64
    blocks = mixing.mixed_blocks(docs).collect()
    assert sum(len(b.words) for b in blocks) == sum(taken.values())


def test_mixing_takes_what_its_slots_hold(spark):
    """Words taken of each document, from the list of slots and the streams of words, counted one by one; no draw is lost."""
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "abc"[i % 3] if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, block = settle(mixing.laid_out(docs, 4), "placed"), 4
    targets = settle(mixing.source_targets(placed.select("source", "size")), "targets")
    stream, goal = {}, {r.source: r for r in targets.collect()}
    for r in sorted(placed.collect(), key=lambda r: r.start):
        stream.setdefault(r.source, []).extend([r.doc_id] * r["size"])
    slots = mixing.slots(targets, block).collect()
    count, seen = Counter(), {}
    for r in slots:
        count.update(stream[r.source][r.block * block : (r.block + 1) * block])
        seen.setdefault((r.source, r.turn), []).append(r.block)
    assert {r.doc_id: r.taken for r in mixing.mix(docs, block=block).collect()} == {i: count[i] for i, _, _ in rows}
    for source, t in goal.items():
        blocks = -(-t.source_size // block)
        assert sum(r.source == source for r in slots) == min(round(t.target * blocks / t.source_size), 2 * blocks)
        turns = [sorted(x) for (s, _), x in sorted(seen.items(), key=str) if s == source]
        assert turns[0] == list(range(blocks)) if len(turns) > 1 else len(set(turns[0])) == len(turns[0])
    per_shard = Counter((r.shard, r.source) for r in slots)
    assert len({per_shard[k, "a"] for k in range(16)}) > 1  # drawn, not dealt evenly


def test_mixing_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 37, 64):
        t = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(0), 5).alias("x"))
        assert sorted(r.x for r in t.collect()) == list(range(n))


def test_mixing_odd_rows(spark):
    got = mixing.mix(odd(spark), block=4).collect()
    assert len(got) == len(ODD) and sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in ODD) and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_nearest_equal_brute_force_on_few_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.op9_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for q, near in got.items():
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits.append(len({int(ids[i]) for i in order} & {v for v, _ in near.values()}) / 20)
        assert all(sc == pytest.approx(s[ids == v][0]) for v, sc in near.values()) and list(near) == list(range(1, 21))
    assert np.mean(hits) >= 0.9


def test_ties_go_to_the_smallest_id(spark):
    """Four hundred different vectors with inner product 1 with the query, beside nearer and farther ones."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0])] + [(int(i), [1.0, float(a), float(b)]) for i, (a, b) in zip(rng.permutation(np.arange(1, 400)), rng.normal(size=(399, 2)), strict=True)] + [(900 + i, [1.5, 0.0, float(i)]) for i in range(3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.where("vec_id = 0"), target=1.0, per_block=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [900, 901, 902, *range(1, 18)]


def test_more_centroids_and_recall(spark):
    """Recall of the index against brute force, on clustered vectors, with a sample that is a fraction of them."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16)) * 3)[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 60 = 0"), sample=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::60] @ x.T
    s[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[60 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9


def test_several_groups_of_queries_equal_brute_force(spark):
    """More queries than a group holds, in several blocks: each finds what a single group finds."""
    x = np.random.default_rng(3).normal(size=(300, 6))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 3 = 0"), top=5, target=1.0, per_block=64, per_group=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert set(got) == set(range(0, 300, 3)) and all(len(near) == 5 for near in got.values())
    assert np.mean([len(set(near) & set(np.argsort(-s[q])[:5].tolist())) / 5 for q, near in got.items()]) >= 0.97


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(1, 30)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    bad = [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (206, [1.0]), (None, [1.0] * 6), (1, rows[0][1])]
    v = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "'x' AS v")
    got = ann.nearest(v, top=20).collect()
    assert {r.vec_id for r in got} | {r.query_id for r in got} <= {r[0] for r in rows}
    ties = [r.vec_id for r in sorted([r for r in got if r.query_id == 130 and r.score == 1.0], key=lambda r: r["rank"])]
    assert ties == sorted(ties) and 130 not in ties and len(got) == 20 * len(rows)
    assert ann.nearest(v.limit(0)).count() == 0


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(2, [1.0, 0.5]), (2, [5.0, 0.5]), (2, [5.0, 0.5]), (3, [0.5, 0.5]), (4, [0.25, 0.5]), (3, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(v, target=1.0).collect()}
    assert [got[3, i] for i in range(1, 5)] == [(2, 2.75), (2, 2.75), (2, 0.75), (4, 0.375)] and (3, 5) not in got
    assert [got[4, i] for i in range(1, 6)] == [(3, 6.75), (2, 1.5), (2, 1.5), (2, 0.5), (3, 0.375)]
    own = spark.createDataFrame([(1, [1.0, 1.0])] * 30 + [(i, [1.0, 1.0]) for i in range(2, 30)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(own, own.where("vec_id = 1"), top=20).orderBy("rank").collect()] == list(range(2, 22))


def test_many_vectors_of_the_query_leave_the_candidates(spark):
    v = spark.createDataFrame([(0, [1.0, i / 100]) for i in range(30)] + [(i, [0.5, -i / 100]) for i in range(1, 41)], "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.where("vec_id = 0"), target=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.5) for i in range(1, 21)]


def test_warc_equals_sql(spark, sf_dir):
    same(warc.op2_warc(spark, sf_dir), warc.ORACLE, sf_dir)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\n", "same"), (5, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "http://b", "same"), (None, "n", "été" * 9), (8, "long", "<p>é</p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha", "1 AS refers_to")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    got = {(r.page_id, r.record_type): r for r in warc.read_archives(spark, path).collect()}
    assert got[1, "revisit"].refers_to == 5 and got[1, "revisit"].payload_bytes == 4 and got[5, "response"].payload == b"same" and got[3, "revisit"].refers_to == 4
    assert got[8, "response"].payload.decode() == rows[-1][2] and got[None, "response"].payload_bytes == 45
    warc.write_archives(pages, f"{path}2", min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, f"{path}2").collect()} == {"response"}
    warc.write_archives(pages.limit(0), f"{path}3")
    assert warc.read_archives(spark, f"{path}3").count() == 0


def test_warc_reader_finds_damage():
    import zlib

    good = warc._record(1, "u", b"x", warc._sha1(b"x"), None, False, "2024-01-01T00:00:00Z")
    member = warc._member(good, 6)
    assert len(list(warc.records(member + b"\0\0" + member, step=7))) == 2
    for bad in (member[:-20], warc._member(good[:-1], 6), warc._member(good.replace(b"\r\n\r\nx", b"\r\n\r\ny"), 6)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(bad))


def test_token_counts(spark, sf_dir, tmp_path):
    enc = token_counts.encoder(token_counts.VOCABULARY)
    docs = documents(spark, sf_dir)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted(map(tuple, token_counts.op10_token_counts(spark, sf_dir).collect())) == want
    token_counts.write_token_files(docs.repartition(3), f"file://{tmp_path}/t")
    for block in (7, 1000):  # documents over many blocks, and many in one
        assert sum(r.n_tokens for r in token_counts.stitch(token_counts.block_scan(spark, f"file://{tmp_path}/t", block=block)).collect()) == sum(n for _, n in want)


def test_token_counts_odd_rows(spark, tmp_path):
    enc = token_counts.encoder(token_counts.VOCABULARY)
    rows = odd(spark).unionByName(odd(spark).limit(1).selectExpr("99L AS doc_id", "'<|endoftext|> a' AS text", *[c for c in odd(spark).columns if c not in ("doc_id", "text")]))
    token_counts.write_token_files(rows, f"file://{tmp_path}/o")
    got = token_counts.token_counts(spark, f"file://{tmp_path}/o").collect()
    want = [(r[0], len(enc.encode_ordinary(r[1] or ""))) for r in ODD] + [(99, len(enc.encode_ordinary("<|endoftext|> a")))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    token_counts.write_token_files(rows.limit(0), f"file://{tmp_path}/e")
    assert token_counts.token_counts(spark, f"file://{tmp_path}/e").count() == 0


def test_files_are_cut_between_documents(spark, tmp_path):
    enc, path = token_counts.encoder(token_counts.VOCABULARY), f"file://{tmp_path}/c"
    rows = [(i, f"word {i} " * (i * 37 % 50)) for i in range(200)] + [(500, "long text " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    token_counts.write_token_files(docs, path, file_bytes=1000)
    assert sorted(map(tuple, token_counts.token_counts(spark, path).collect())) == sorted((i, len(enc.encode_ordinary(t))) for i, t in rows)
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    warc.write_archives(pages, f"{path}w", archive_bytes=500)
    assert {(r.page_id, r.payload_bytes) for r in warc.read_archives(spark, f"{path}w").collect()} == {(i, len(t)) for i, t in rows}
    assert len(list(tmp_path.glob("cw/cut=*"))) > 3
