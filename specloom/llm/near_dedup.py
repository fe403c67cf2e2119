"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. A text's set is its distinct word shingles, as 64-bit hashes. Equal sets (by a 128-bit digest of the sorted set) are one
   class with its smallest id as representative; only representatives go on, so exact copies cost a row each.
2. ``bands`` * ``rows`` MinHash values make band keys, and the same samples are folded into an odd sketch: a bitmap in which sample
   (i, value) flips one bit. The XOR of two sketches has few bits where the sets are alike, and its population count gives
   the similarity, most precisely for high ones.
3. Members of a band bucket are linked with the bucket's smallest id. Sketches drop the pairs that are far from the threshold;
   the others are confirmed on both full sets. Components follow.
4. A bucket that still has several components may hide links between members that aren't its smallest. Members of such buckets
   are compared by sketches inside tasks, block against block, which gives clusters of nodes that may be similar across
   components. Clusters are compared by full sets the same way; what comes out is a confirmed link for each pair of components,
   never the pairs that were looked at. So no link between components is lost, and a bucket of thousands of near copies that
   are one component before step 4 is not compared again.

With 32 bands of 4 rows, a pair of similarity 0.75 shares no bucket with a chance of 0.5 in 100,000. The estimate from 128 samples has a
deviation of 0.038 at 0.75 (and the sketch adds a little); the limit is 0.25 below the threshold, over six of them, as full sets decide anyway.

Scale: texts to be confirmed against one head are gathered in blocks of ``PACK`` shingles, so a head's text is sent once per block and
not once per member, and a head with most members is many blocks. Blocks of members are bounded in members and in bytes.

Defined cases: texts without words have an empty set and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows that repeat a doc_id with different texts are linked with each other, each under the signature of its own text; null ids
keep their rows, with a null component, and are linked with nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop, lean, pieces, settle, split_words, table
from .components import components

SKETCH_BITS = 2048
PACK = 1 << 17
#: Bytes of texts whose shingles a task has at a time: these take about 30 times the room of their texts.
SLICE = 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = flat.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else own


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text starts (one more entry)."""
    flat, starts = split_words(texts)
    h, n_words = _word_hashes(flat), np.diff(starts)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    first = starts[:-1][owner] + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n_shingles)])[:-1], n_shingles)
    length = np.minimum(n_words, width)[owner]
    s = np.full(len(owner), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        on = k < length
        s[on] = _mix(s[on] * np.uint64(0xFF51AFD7ED558CCD) + h[first[on] + k] + np.uint64(k + 1))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n_words) + 1))


def _minhash(s: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """``k`` MinHash values for each text with a nonempty set; 2^64 - 1 for the others."""
    full = np.diff(starts) > 0
    out = np.full((len(full), k), np.iinfo(np.uint64).max, np.uint64)
    if len(s):
        at, buffer = starts[:-1][full], np.empty_like(s)
        rng = np.random.default_rng(3)
        multipliers, shifts = rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)
        for i in range(k):
            np.multiply(s, multipliers[i], out=buffer)
            np.add(buffer, shifts[i], out=buffer)
            out[full, i] = np.minimum.reduceat(buffer, at)
    return out


def _sketches(mins: np.ndarray) -> np.ndarray:
    """Odd sketches: each sample flips one bit of its text's bitmap."""
    n, k = mins.shape
    if n > 512:
        return np.concatenate([_sketches(mins[i : i + 512]) for i in range(0, n, 512)])
    bit = (_mix(mins + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Similarity from the differing bits of sketches made of ``k`` samples (rows of a and b, or broadcast)."""
    differ = _POP[a ^ b].sum(axis=-1)
    flips = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9))
    return 1 - flips / (2 * k)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, keys, sketch) of rows (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                s, starts = shingle_sets(part.column("text"), width)
                mins = _minhash(s, starts, bands * rows)
                keys = np.full((len(mins), bands), 0, np.uint64)
                for r in range(rows):
                    keys = _mix(keys * np.uint64(31) + mins[:, r::rows] + np.arange(bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
                raw = s.tobytes()
                digest = [hashlib.blake2b(raw[a * 8 : b * 8], digest_size=16).digest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                sketch = [x.tobytes() for x in _sketches(mins)]
                offsets = pa.array(np.arange(len(mins) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts)), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "digest", "keys", "sketch"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(sign), "doc_id long, n_shingles long, digest binary, keys array<bigint>, sketch binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()]) if len(column) else np.empty((0, SKETCH_BITS // 8), np.uint8)


def _promising(pairs: DataFrame, k: int, limit: float) -> DataFrame:
    """Pairs (a, b) of rows (a, b, sketch_a, sketch_b) that the sketches don't rule out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = pa.array(estimate(_bits(b.column("sketch_a")), _bits(b.column("sketch_b")), k) >= limit)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(on), b.column("b").filter(on)], ["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(keep), "a long, b long").distinct()


def _shared(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of some sorted sets, how many values it has and how many of them are in the sorted set ``x``."""
    size = np.array([len(y) for y in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every if len(x) else np.zeros(len(every), bool)
    return size, np.bincount(np.repeat(np.arange(len(sets)), size), hit, len(sets))


def _confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union. ``sets``: rows (node, text); ``sizes``: (node, n_shingles)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head, members = batch.column("text_a").slice(i, 1), batch.column("members")[i].values
                x, _ = shingle_sets(head, width)
                y, at = shingle_sets(members.field("text"), width)
                size, both = _shared(x, [y[p:q] for p, q in zip(at[:-1], at[1:], strict=True)])
                on = 100 * both >= percent * (len(x) + size - both)
                b = members.field("b").filter(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), batch.column("a")[i].as_py())), b], ["a", "b"])

    weighed = settle(pairs.join(sizes.groupBy(F.col("node").alias("b")).agg(F.sum("n_shingles").alias("w")), "b"), "weighed")
    blocks = weighed.groupBy("a").agg(F.ceil(F.sum("w") / PACK).alias("blocks"))
    dealt = settle(weighed.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block")), "dealt")
    two = sets.select(F.col("node").alias("b"), "text")
    members = dealt.join(two, "b").groupBy("a", "block").agg(F.collect_list(F.struct("b", "text")).alias("members"))
    one = dealt.select("a", "block").distinct().join(sets.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(members, ["a", "block"]).select("a", "text_a", "members").mapInArrow(lean(compare), "a long, b long").distinct()


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected with by links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(rows: DataFrame, group: str, columns: list[str], size: int, limit: int = 4 << 20) -> DataFrame:
    """Pairs of blocks (left, right: arrays of structs) of a group; a block has about ``size`` members and ``limit`` bytes (column ``weight``)
    at most. Blocks of one large component have no other members and aren't paired with each other."""
    n = rows.groupBy(group, "component").agg(F.count("*").alias("m"), F.sum("weight").alias("w")).withColumn("owner", F.when(F.col("m") > size // 8, F.col("component")))
    of = n.groupBy(group, "owner").agg(F.greatest(F.ceil(F.sum("m") / size), F.ceil(F.sum("w") / limit)).alias("parts"))
    dealt = rows.join(n.select(group, "component", "owner"), [group, "component"]).join(of.select(F.col(group).alias("g"), F.col("owner").alias("o"), "parts"), (F.col(group) == F.col("g")) & F.col("owner").eqNullSafe(F.col("o")))
    part = F.concat_ws("/", "owner", F.pmod(F.xxhash64("node"), "parts"))
    blocks = dealt.groupBy(group, "owner", part.alias("part")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    left = blocks.select(group, F.col("owner").alias("own_l"), F.col("part").alias("p"), F.col("rows").alias("left"))
    right = blocks.select(group, F.col("owner").alias("own_r"), F.col("part").alias("q"), F.col("rows").alias("right"))
    other = ~F.coalesce(F.col("own_l") == F.col("own_r"), F.lit(False))
    return left.join(right, group).where((F.col("p") <= F.col("q")) & other).select("left", "right")


def _doubtful(members: DataFrame, k: int, limit: float, size: int = 512) -> DataFrame:
    """Links (a, b) that connect, within their buckets, the nodes of different components that sketches don't rule out as similar:
    not pairs, but as few links as connect them. ``members``: (key, node, component, sketch) of the buckets with several components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = left.values, right.values
                (a, ca), (b, cb) = ((v.field("node").to_numpy(), v.field("component").to_numpy()) for v in (x, y))
                sa, sb = _bits(x.field("sketch")), _bits(y.field("sketch"))
                one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i in range(len(a)):
                    on = np.flatnonzero(cb != ca[i])
                    on = on[estimate(sa[i], sb[on], k) >= limit]
                    one.append(np.full(len(on), i))
                    two.append(on + len(a))
                one, two = np.concatenate(one), np.concatenate(two)
                nodes, used = np.concatenate([a, b]), np.unique(np.concatenate([one, two]))
                root = _labels(len(nodes), one, two)[used]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[root]), pa.array(nodes[used])], ["a", "b"])

    members = members.withColumn("weight", F.lit(SKETCH_BITS // 8))
    return _blocks(members, "key", ["node", "component", "sketch"], size).mapInArrow(lean(compare), "a long, b long").distinct()


def _hidden(doubtful: DataFrame, labelled: DataFrame, texts: DataFrame, width: int, percent: int, k: int, limit: float, size: int = 512) -> DataFrame:
    """Confirmed links (a, b) between different components among connected ``doubtful`` nodes, one for each pair of components and blocks.
    Full sets meet in tasks, block against block. ``labelled``: (node, component, sketch)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                s, at = shingle_sets(part.column("text"), width)
                raw = s.tobytes()
                sets = [raw[i * 8 : j * 8] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    cluster = components(doubtful).select("node", F.col("component").alias("cluster"))
    sets = texts.join(cluster, "node", "left_semi").mapInArrow(lean(shingled), "node long, set binary")
    rows = settle(cluster.join(labelled, "node").join(sets, "node").withColumn("weight", F.octet_length("set") + SKETCH_BITS // 8), "clusters")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = left.values, right.values
                (a, ca), (b, cb) = ((v.field("node").to_numpy(), v.field("component").to_numpy()) for v in (x, y))
                sa, sb = _bits(x.field("sketch")), _bits(y.field("sketch"))
                own, other = ([np.frombuffer(z, np.uint64) for z in v.field("set").to_pylist()] for v in (x, y))
                found: dict = {}
                for i, s in enumerate(own):
                    on = np.flatnonzero(cb != ca[i])
                    on = on[estimate(sa[i], sb[on], k) >= limit]
                    on = on[[(ca[i], c) not in found for c in cb[on].tolist()]] if len(on) else on
                    if not len(on) or not len(s):
                        continue
                    each, both = _shared(s, [other[j] for j in on])
                    for j in on[100 * both >= percent * (len(s) + each - both)].tolist():
                        found.setdefault((ca[i], cb[j]), (a[i], b[j]))
                yield pa.RecordBatch.from_arrays([pa.array([v[z] for v in found.values()], pa.int64()) for z in (0, 1)], ["a", "b"])

    return _blocks(rows, "cluster", ["node", "component", "sketch", "set"], size).mapInArrow(lean(compare), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 0.25) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    k, limit = bands * rows, percent / 100 - slack
    signed = settle(signatures(docs, width, bands, rows), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    named = classes.withColumnRenamed("digest", "d")
    reps = settle(full.join(named, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node"))).dropDuplicates(["digest"]).select("node", "n_shingles", "keys", "sketch"), "reps")
    # A repeated id with several sets links their classes.
    holds = full.select("doc_id", "digest").join(named, F.col("digest") == F.col("d")).select("doc_id", "node")
    several = holds.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    own = settle(holds.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct(), "own")

    members = reps.select("node", F.explode("keys").alias("key"))
    heads = settle(members.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    members = settle(members.join(heads, "key").select("key", "node", "head"), "members")
    sketch = reps.select("node", "sketch")
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()

    def with_sketches(pairs: DataFrame) -> DataFrame:
        a = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
        b = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(a, "a").join(b, "b")

    promising = settle(_promising(with_sketches(stars), k, limit), "promising")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    links = settle(_confirmed(promising, texts, reps.select("node", "n_shingles"), width, percent).union(own), "confirmed")
    found = settle(components(links), "components")

    labelled = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    mixed = settle(mixed, "mixed")
    doubtful = settle(_doubtful(labelled.join(mixed, "key", "left_semi").join(sketch, "node"), k, limit), "doubtful")
    with_component = reps.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sketch")
    more = _hidden(doubtful, with_component, texts, width, percent, k, limit)
    found_all = settle(components(links.union(more).union(found.select("component", "node"))), "components")
    drop(heads, members, promising, found, mixed, doubtful)

    of_class = classes.join(found_all, "node", "left").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    out = signed.join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
