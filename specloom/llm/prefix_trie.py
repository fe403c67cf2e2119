"""Prefix trie of conversations: how often turns are shared, and what computing each shared prefix once would save.

A turn is 16 bytes of the SHA-256 of its role and text, a conversation the path of its turns, and a node of the trie a prefix of paths.
Paths are dealt into ranges by splitters from a sample, ordered by path and then by id, so that a group of equal paths can be cut anywhere. The
splitters' paths form the skeleton, a trie that every task gets. A node that is no prefix of a splitter has all its members in one
shard: a scan over the sorted shard with a stack finishes it. A skeleton node's members lie in several: each shard reports its part
(members that end there, smallest member, finished subtrees below), parts are added by node, and sums over subtrees are taken
bottom up along the skeleton.

Bounded: the sample by ``per_shard`` paths for each shard and ``SAMPLE_BYTES`` in all, and with it the skeleton; a shard by its share of the turns. One conversation's path is
one row (24 bytes a turn with its count of words). The ids that end at one node are hashed in order, since SHA-256 has no parallel form; ids of a skeleton node come as
one chunk per shard and are streamed.

Defined cases: rows without a conversation id are left out; null roles and texts are empty; null turns come first, turns with the same number are ordered by
role and text; repeated rows are turns each; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, lean, settle, table

STEP = 16
SAMPLE_BYTES = 64 << 20
_BATCH = 20_000
PATHS = "conv_id long, path binary, words array<long>"


def _turn(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.sha256(len(r).to_bytes(8, "big") + r + text.encode()).digest()[:STEP]


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["conv_id", "path", "words"])


def plain_paths(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, path, words): the conversations as they are."""
    return rebuilt_paths(turns, F.col("conv_id"), F.lit(0))


def rebuilt_paths(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Rows (conv_id, path, words): each conversation with its first ``head`` turns replaced by those of conversation ``base``. Both are columns over
    ``conv_id``; ``head`` is 3 at most. A base is sorted before the conversations that start with it, so only 3 of its turns are held for them."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"base": base.cast("long"), "head": head.cast("int"), "words": F.size(F.filter(F.split("text", SPACES), lambda w: w != ""))})
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, of, first, open_ = [], None, [], None  # of: the base whose first turns are held; open_: [id, base, head, turns, words]

        def close(c: list) -> None:
            nonlocal of, first
            own = list(zip(c[3], c[4], strict=True))
            if c[0] == c[1]:
                of, first = c[0], own[:3]
            whole = (first[: c[2]] if of == c[1] else []) + own[c[2] :]
            done.append((c[0], b"".join(t for t, _ in whole), [w for _, w in whole]))

        for batch in batches:
            for i, b, h, role, text, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "base", "head", "role", "text", "words")), strict=True):
                if open_ is None or open_[0] != i:
                    if open_ is not None:
                        close(open_)
                    open_ = [i, b, h, [], []]
                open_[3].append(_turn(role, text))
                open_[4].append(n)
            if len(done) >= _BATCH:
                yield _paths(done)
                done.clear()
        if open_ is not None:
            close(open_)
        if done:
            yield _paths(done)

    return rows.select("conv_id", "base", "head", "role", "text", "words").mapInArrow(lean(build), PATHS)


def _common(a: bytes, b: bytes) -> int:
    """How many leading turns two paths share."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    x, y = np.frombuffer(a, np.uint8, n * STEP), np.frombuffer(b, np.uint8, n * STEP)
    return int((x != y).argmax()) // STEP


class Skeleton:
    """The trie of the splitters: ``ids[k][d]`` is the node of splitter k's first d turns; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters, self.ids, self.parent, self.depth, last = splitters, [], [-1], [0], (b"", [0])
        for path, _ in splitters:
            ids = last[1][: _common(last[0], path) + 1]
            for d in range(len(ids), len(path) // STEP + 1):
                self.parent.append(ids[-1])
                self.depth.append(d)
                ids = [*ids, len(self.parent) - 1]
            self.ids.append(ids)
            last = (path, ids)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv))

    def nodes(self, shard: int, path: bytes) -> list[int]:
        """The skeleton's nodes on a path of that shard, from the root down."""
        near = [k for k in (shard - 1, shard) if 0 <= k < len(self.splitters)]
        return max((self.ids[k][: _common(self.splitters[k][0], path) + 1] for k in near), key=len, default=[0])


def _splitters(paths: DataFrame, shards: int, per_shard: int) -> list[tuple[bytes, int]]:
    n, size = paths.agg(F.count("*"), F.sum(F.length("path"))).first()
    share = min(1.0, per_shard * shards / max(n, 1), SAMPLE_BYTES / max(size or 0, 1))
    key = F.pmod(F.xxhash64(F.lit(7), "conv_id"), F.lit(1 << 30))
    sample = sorted((bytes(r.path), r.conv_id) for r in paths.where(key < math.ceil((1 << 30) * share)).select("path", "conv_id").collect())
    return [sample[i * len(sample) // shards] for i in range(1, shards) if i * len(sample) // shards > (i - 1) * len(sample) // shards]


#: From a shard: finished nodes (kind 0; ``parent``: the skeleton node above; null where ``parent_conv_id`` is known), and parts of skeleton nodes (kind 1, ``node``).
PARTS = ["kind", "node", "parent", "shard", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "last_words"]
PART_SCHEMA = ", ".join(f"{c} long" for c in PARTS) + ", ends_sha256 string, ends binary"


def _hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Shard:
    """Scans the sorted paths of one shard. A stack holds the nodes of the current path: [least member, members, children, leaves, saved, last words, ids that end here, finished children that wait for this node's least member]."""

    def __init__(self, number: int, skeleton: Skeleton):
        self.number, self.skeleton, self.last, self.stack, self.line, self.out = number, skeleton, b"", [self._new(0)], [0], []

    @staticmethod
    def _new(words: int) -> list:
        return [None, 0, 0, 0, 0, words, [], []]

    def add(self, path: bytes, conv: int, words: list[int]) -> None:
        common = _common(self.last, path)
        self._close(common + 1)
        self.line = self.skeleton.nodes(self.number, path)
        for w in words[common:]:
            self.stack.append(self._new(w))
        top = self.stack[-1]
        top[6].append(conv)
        top[1] += 1
        top[0] = conv if top[0] is None else min(top[0], conv)
        self.last = path

    def _close(self, to: int) -> None:
        while len(self.stack) > to:
            depth = len(self.stack) - 1
            least, members, children, leaves, saved, words, ends, waiting = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if above is not None:
                above[0], above[1] = least if above[0] is None else min(above[0], least), above[1] + members
            if depth < len(self.line):  # the skeleton's
                self.out.append((1, self.line[depth], None, self.number, least, depth, None, members, children, leaves, saved, words, None, ",".join(map(str, ends)).encode()))
                continue
            leaves, saved = leaves + (children == 0), saved + (members - 1) * words
            self.out += [(0, None, None, self.number, *row[:2], least, *row[2:6], None, row[6], None) for row in waiting]
            above[2], above[3], above[4] = above[2] + 1, above[3] + leaves, above[4] + saved
            row = (least, depth, members, children, leaves, saved, _hash(ends))
            if depth == len(self.line):  # right below the skeleton: the parent's least member is known after the reduction
                self.out.append((0, None, self.line[-1], self.number, *row[:2], None, *row[2:6], None, row[6], None))
            else:
                above[7].append(row)

    def finish(self) -> list[tuple]:
        self._close(0)
        return self.out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * len(PARTS) + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*PARTS, "ends_sha256", "ends"])


def _stream_hashes(parts: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256): ids of skeleton nodes, hashed chunk by chunk in the order of shards."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, empty, done = None, None, True, []
        for batch in batches:
            for n, chunk in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
                if n != node:
                    if node is not None:
                        done.append((node, h.hexdigest()))
                    node, h, empty = n, hashlib.sha256(), True
                if data := chunk.as_py():
                    h.update(data if empty else b"," + data)
                    empty = False
        if node is not None:
            done.append((node, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "shard").select("node", "ends").mapInArrow(join, "node long, ends_sha256 string")


def trie(paths: DataFrame, shards: int | None = None, per_shard: int = 32, turns_per_shard: int = 200_000) -> DataFrame:
    """A row per node of the trie of ``paths`` (settled rows conv_id, path, words; an id once): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    if shards is None:
        size = paths.agg(F.sum(F.length("path"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (STEP * turns_per_shard)))
    skeleton = Skeleton(_splitters(paths, shards, per_shard))
    shared = spark.sparkContext.broadcast(skeleton)  # at most SAMPLE_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("shard", pa.array([shared.value.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)], pa.int64()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for shard, path, conv, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
                if at is None or at.number != shard:
                    if at is not None:
                        yield _table(at.finish())
                    at = _Shard(shard, shared.value)
                at.add(path, conv, words)
                if len(at.out) >= _BATCH:
                    yield _table(at.out)
                    at.out = []
        if at is not None:
            yield _table(at.finish())

    dealt = paths.mapInArrow(deal, PATHS + ", shard long").repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = settle(dealt.mapInArrow(lean(scan), PART_SCHEMA), "trie-parts")
    part = parts.where("kind = 1")
    sums = part.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("last_words").alias("words")).collect()  # the skeleton's size at most
    spine = spark.createDataFrame(_reduce(skeleton, sums), "node long, " + NODES).join(_stream_hashes(part), "node", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hung = parts.where("kind = 0").drop("node").join(F.broadcast(spine.select("node", F.col("conv_id").alias("above"))), F.col("parent") == F.col("node"), "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return hung.select(columns).unionByName(spine.select(columns))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _reduce(skeleton: Skeleton, sums: list) -> list[tuple]:
    """Rows of the skeleton's nodes that have members, from the added parts: a node comes after its parent, so subtrees are added from the end."""
    found = {r.node: [r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.words] for r in sums}
    for node in range(len(skeleton.parent) - 1, 0, -1):
        if node in found:
            x, above = found[node], found[skeleton.parent[node]]
            x[3], x[4] = x[3] + (x[2] == 0), x[4] + (x[1] - 1) * x[5]
            above[2], above[3], above[4] = above[2] + 1, above[3] + x[3], above[4] + x[4]
    if 0 in found:
        found[0][3] += found[0][2] == 0
    return [(node, x[0], skeleton.depth[node], found[skeleton.parent[node]][0] if node else None, *x[1:5]) for node, x in found.items()]


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of ``conversations``, each with the beginning of another: the contract's rule."""
    conv = F.col("conv_id").cast("long")
    return rebuilt_paths(table(spark, sf_dir, "conversations"), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)


ORACLE = """
WITH RECURSIVE crc AS (SELECT x, x AS v, 0 AS i FROM range(256) t(x) UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY x) AS t FROM crc WHERE i = 8),
o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS MATERIALIZED (SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4)::INT AS h FROM o, tab),
c AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS p FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS MATERIALIZED (SELECT conv_id, d::INT AS depth, p[:d] AS k, d = len(p) AS ends FROM c, unnest(range(0, len(p) + 1)) u(d)),
n AS MATERIALIZED (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS sha, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(string_split_regex(k[depth]['t'], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS own FROM m GROUP BY k, depth),
f AS MATERIALIZED (SELECT n.k, count(x.k) AS children FROM n LEFT JOIN n x ON x.depth = n.depth + 1 AND x.k[:n.depth] = n.k GROUP BY n.k),
u AS (SELECT n.k[:d] AS k, sum((children = 0)::INT) AS leaves, sum(own) AS saved FROM n JOIN f ON n.k = f.k, unnest(range(0, n.depth + 1)) u(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.sha AS ends_sha256
FROM n JOIN f ON f.k = n.k JOIN u ON u.k = n.k LEFT JOIN n a ON n.depth > 0 AND a.k = n.k[:n.depth - 1] AND a.depth = n.depth - 1"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(settle(rebuilt(spark, sf_dir), "paths"))
