import hashlib

import numpy as np
import pytest

from specloom.llm import near_dedup, suffix_dedup
from specloom.llm.components import components

from .util import ODD, documents, odd, shingles


def brute_components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i in ids:
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    both = {}
    for members in by.values():
        for k, b in enumerate(members):
            for a in members[:k]:
                both[a, b] = both.get((a, b), 0) + 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hidden_links_and_hot_groups(spark):
    """Near copies of near copies: the ends are less alike than the threshold, and are one component by the middle."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(f"v{i}" if i < 2 * k else w for i, w in enumerate(base))) for k in range(8)] + [(100 + k, " ".join(base)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_repeated_id_with_two_texts_links_both(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(3, base), (5, base + " x"), (5, other), (9, other + " y"), (11, " ".join(f"z{i}" for i in range(30)))]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def test_very_long_texts_and_one_common_head(spark):
    """A text of half a million words beside its near copy, and a head with members in several blocks."""
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(500_000))
    head = [f"v{i}" for i in range(3_000)]
    rows = [(1, long), (2, long + " end")] + [(10 + k, " ".join([*head[: 3_000 - k], f"t{k}"])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1} | {10 + k: 10 for k in range(120)}


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[6].component_id == 1 and not by[6].kept and by[5].n_shingles == 1
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (2, 3, 4)) and by[None].component_id is None
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(0, 1 << 63, 1000, np.uint64))
    t = np.sort(np.concatenate([s[:900], rng.integers(0, 1 << 63, 100, np.uint64)]))
    mins = near_dedup._minhash(np.concatenate([s, t]), np.array([0, 1000, 2000]), 256)
    a, b = near_dedup._sketches(mins)
    assert abs(near_dedup.estimate(a, b, 256) - 900 / 1100) < 0.1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}


def brute_cut(rows, length=50):
    out, starts = [], {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            starts[w] = min(starts.get(w, 1 << 62), 1 << 61 if i is None else i)
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] < (1 << 61 if i is None else i):
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 60_000, "bucket_bytes": 20_000}])
def test_passages_equal_brute_force(spark, sf_dir, sizes):
    docs = documents(spark, sf_dir)
    got = suffix_dedup.repeated(docs, outputs=(), **sizes).collect()
    assert sorted(map(tuple, got), key=str) == brute_cut([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_anchors_and_long_texts(spark):
    """Template lines with a number that varies: one anchor with as many segments as documents, some of them equal. A long text beside them."""
    rng = np.random.default_rng(3)
    line = "the quarterly report number {} of the regional office in the capital city was filed {} days after it was due"
    rows = [(i, " ".join([f"w{rng.integers(0, 1 << 30)}", line.format(int(rng.integers(0, 60)), int(rng.integers(0, 9))), f"v{rng.integers(0, 1 << 30)}"])) for i in range(120)]
    rows += [(500, "".join(f"{int(x):06d} " for x in rng.integers(0, 10**6, 40_000))), (501, None)]
    rows.append((502, rows[120][1][100_000:100_400] + rows[3][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_cut(rows)
    for options in ({"hot_segments": 2, "batch_bytes": 4_000, "bucket_bytes": 2_000}, {"batch_bytes": 4_000}):
        assert sorted(map(tuple, suffix_dedup.repeated(docs, outputs=(), **options).collect()), key=str) == want


def test_passages_odd_rows(spark):
    got = suffix_dedup.repeated(odd(spark), outputs=("kept", "kept_text", "spans"), carry=("lang", "score")).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute_cut([(r[0], r[1]) for r in ODD])
    assert all(r.score == "clash" and sum(s.bytes for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert suffix_dedup.repeated(odd(spark).limit(0)).count() == 0


def test_segments_and_keys_do_not_depend_on_slices(monkeypatch):
    """Arrays with an entry for each byte are made for a slice of the texts at a time: a batch takes less than 20 bytes a byte beside its text."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcé \n"), int(n))) for n in rng.integers(0, 400, 300)] + [None, "", "x" * 49, "y" * 5000]
    t = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    got = []
    for size in (1 << 30, 1000, 1):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        b = suffix_dedup.Batch(t, 50)
        at = np.arange(len(b.start))[::-1]
        got.append([x.tolist() for x in (b.anchor, b.start, b.count, b.doc, b.keys(50, at))])
    assert got[0] == got[1] == got[2] and len(got[0][0]) > 100
    monkeypatch.undo()
    big = pa.table({"doc_id": pa.array(range(8), pa.int64()), "text": pa.array(["".join(map(chr, rng.integers(97, 123, 1 << 19))) for _ in range(8)])})
    tracemalloc.start()
    suffix_dedup.Batch(big, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 22


def test_buckets_are_sorted_in_parts():
    """Runs of windows equal those of one sort over all segments, in less than 40 bytes a byte."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    lines = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(400)]
    texts = [" ".join(lines[k] for k in rng.integers(0, len(lines), 6)) for _ in range(1000)]
    b = suffix_dedup.Batch(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), 50)
    keys, size, ids = b.keys(50, np.arange(len(b.start))), b.count + 49, b.ids[b.doc]
    # Segments of one anchor share the lowest bits, and all values of these occur.
    part = keys & (suffix_dedup.PARTS - 1)
    assert len(set(zip(b.anchor.tolist(), part.tolist(), strict=True))) == len(set(b.anchor.tolist())) and set(part.tolist()) == set(range(suffix_dedup.PARTS))
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    least = np.full(len(one), suffix_dedup.LAST)
    np.minimum.at(least, which, ids)
    place = np.concatenate([np.arange(b.start[k], b.start[k] + size[k]) for k in one])
    first = suffix_dedup.first_documents(b.bytes[place], size[one], least, 50)
    tracemalloc.start()
    owner, ids, windows, at = suffix_dedup.runs(keys[one], b.bytes, b.start[one], size[one], least, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.repeat(ids, windows).tolist() == first.tolist()
    assert (np.diff(owner) >= 0).all() and np.bincount(owner, windows).tolist() == (size[one] - 49).tolist() and at[0] == 0
    assert most < 40 * len(place), (most, len(place))


def test_difference_cover_order():
    rng = np.random.default_rng(0)
    for _ in range(100):
        s, depth = rng.integers(1, rng.integers(2, 5), int(rng.integers(1, 70))), int(rng.integers(1, 60))
        rank = suffix_dedup._ranks(s.astype(np.int64), depth)
        heads = [tuple(s[i : i + depth]) for i in range(len(s))]
        assert all(rank[i] < rank[j] for i in range(len(s)) for j in range(len(s)) if heads[i] < heads[j])
