"""Approximate nearest neighbours by largest inner product: an inverted multi-index over two vector halves.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for a
query). Each half of the vector has its own codebook of ``k`` centroids; a cell is a pair of centroids. A query sorts the
centroids of both halves by distance and traverses pairs by summed distance with a heap, until the visited cells hold the
wanted share of all vectors; entries of visited cells are reranked by the inner product of the original vectors.

Codebooks are fitted on a bounded sample (about ``sample`` vectors, by a hash of the id); every vector is indexed. The share to
visit is the smallest for which the sample's own queries reach ``target`` recall, so clustered vectors need few cells and
vectors without structure need many.

Scale: equal vectors are one entry with its ``top`` + 1 smallest ids, each as often as it has that vector but ``top`` times at most (no later id of an equal vector can be
among the nearest), found with a rank limit that already holds before the shuffle. Cells are packed into blocks of about
``per_block`` entries and large cells are split, so a crowded cell is several tasks; queries come in groups of about
``per_group``. A task holds a group of queries, each with a bit for every cell that it visits, and the entries of some blocks in a row pass by in the order of cells:
a cell is multiplied with the queries that visit it, and ``top`` + 1 entries a query stay. All that could be level with
the last of them are compared by the exact sum and then by their smallest id, so ties are settled on all of a task's entries. A query
and what a task found for it are sent once for each run of blocks, an entry once for each group.
Queries are dealt out before they traverse cells, once. Vectors of floats stay floats until they are multiplied. The number of centroids grows with the fourth root of the number of vectors, so cells grow with its
square root, and only their sizes come to the driver. Without clusters the pairs to multiply are a share of all, so they grow with the square of the input.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
of another length than the most frequent one; null ids take no part; every row is a candidate, so a repeated vec_id is found as often as it has rows; a query has
the smallest vector (as an array) of its id, and no row of its id is a candidate for it; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, lean, settle, table

SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v): the rows whose vector can take part; floats stay floats, other components become doubles."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(sound)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            own = near == j
            if own.any():
                c[j] = x[own].mean(axis=0)
    return c


def _halves(x: np.ndarray, largest: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the lengthened vectors; ``largest`` None: of queries."""
    last = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(largest * largest - (x * x).sum(1), 0))
    h = (x.shape[1] + 1) // 2
    return x[:, :h], np.hstack([x[:, h:], last[:, None]])


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: list[int], wanted: int) -> list[int]:
    """Cells in the order of summed distance until they hold ``wanted`` entries. ``counts``: entries per cell, flat."""
    o1, o2, k2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, reached, held, out = [(s1[0] + s2[0], 0, 0)], [0] * len(s1), 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k2 + o2[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def _share(x: np.ndarray, index: dict, top: int, target: float, queries: int = 200) -> float:
    """The share of all entries to visit, from queries of the sample against the sample."""
    h1, h2 = _halves(x, index["largest"])
    cell = np.argmin(_near(h1, index["c1"]), 1) * len(index["c2"]) + np.argmin(_near(h2, index["c2"]), 1)
    counts, q = np.bincount(cell, minlength=len(index["c1"]) * len(index["c2"])), x[:queries]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(top, len(x) - 1)]
    q1, q2 = _halves(q, None)
    d1, d2 = _near(q1, index["c1"]), _near(q2, index["c2"])
    need, sizes = [], counts.tolist()
    for i in range(len(q)):
        order = traverse(d1[i], d2[i], sizes, len(x))
        at = np.full(len(counts), len(x))
        at[order] = np.cumsum(counts[order])
        need.append(at[cell[best[i]]])
    need = np.sort(np.concatenate(need)) if need else np.array([])
    return 1.0 if not len(need) else float(need[min(len(need) - 1, math.ceil(target * len(need)))] / len(x))


def fit(v: DataFrame, top: int, target: float = 0.97, sample: int = 8192) -> dict | None:
    """Codebooks, largest norm, number of entries and the share to visit."""
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    v = v.where(F.size("v") == size.d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, largest = v.agg(F.count("*"), F.max(norm)).first()
    key = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30))
    taken = v.where(key < math.ceil((1 << 30) * min(1.0, sample / n))).select("vec_id", "v").collect()
    x = np.array([r.v for r in sorted(taken, key=lambda r: (r.vec_id, r.v))])
    if not len(x):  # so few rows that the hash took none
        x = np.array([v.orderBy("vec_id", "v").first().v])
    x = x[np.random.default_rng(SEED).permutation(len(x))]
    h1, h2 = _halves(x, largest)
    k = max(4, min(len(x) // 8, math.ceil(2 * n**0.25)))
    index = {"d": size.d, "n": n, "largest": largest, "c1": _kmeans(h1, k), "c2": _kmeans(h2, k)}
    return index | {"share": _share(x, index, top, target)}


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


class _Best:
    """The ``width`` best entries so far of each query of a group, by the exact sum and then by the smallest id. An entry counts as its position in the stream.
    ``seen``: a row of packed bits for each query, a bit for each cell from ``start`` on."""

    def __init__(self, names: np.ndarray, q: np.ndarray, seen: np.ndarray, start: int, width: int):
        self.names, self.by_name = names, np.argsort(names)
        self.q, self.seen, self.start, self.width, self.size = q, np.ascontiguousarray(seen.T), start, width, np.sqrt((q * q).sum(axis=1))
        self.score, self.least = np.full((len(q), width), -np.inf), np.full((len(q), width), np.iinfo(np.int64).max)
        self.entry = np.full((len(q), width), -1)

    def look(self, cell: int, x: np.ndarray, least: np.ndarray, alone: np.ndarray, at: int) -> None:
        """Entries of one cell; the first is at position ``at``. ``alone``: no other id has that vector, so it is none for the query of that id."""
        byte, bit = divmod(cell - self.start, 8)
        asked = np.flatnonzero(self.seen[byte] >> (7 - bit) & 1)
        step = max(1, (1 << 20) // len(x))
        named = self.by_name[np.minimum(np.searchsorted(self.names, least, sorter=self.by_name), len(self.names) - 1)]
        theirs = np.flatnonzero(alone & (self.names[named] == least))
        for a in range(0, len(asked), step):
            self._look(asked[a : a + step], x, least, at, named[theirs], theirs)

    def _look(self, own: np.ndarray, x: np.ndarray, least: np.ndarray, at: int, named: np.ndarray, theirs: np.ndarray) -> None:
        q, size, w = self.q[own], self.size[own], self.width
        s = q @ x.T
        row = np.minimum(np.searchsorted(own, named), len(own) - 1)
        s[row[own[row] == named], theirs[own[row] == named]] = -np.inf
        longest = float(np.sqrt((x * x).sum(axis=1).max()))
        if not np.isfinite(longest * size.max()):
            s[~np.isfinite(s)] = -np.inf
        last = self.score[own, -1]
        new = last == -np.inf
        if len(x) > w and new.any():
            last[new] = np.partition(s[new], len(x) - w, axis=1)[:, len(x) - w]
        # What rounding can't tell from the last place stays.
        i, j = np.nonzero(s >= (last - np.nan_to_num(1e-12 * x.shape[1] * longest * size, nan=np.inf, posinf=np.inf))[:, None])
        i, j = (k[s[i, j] > -np.inf] for k in (i, j))
        step = max(1, (4 << 20) // x.shape[1])
        exact = np.concatenate([np.empty(0), *((x[j[p : p + step]] * q[i[p : p + step]]).sum(axis=1) for p in range(0, len(i), step))])
        last, least_last = self.score[own[i], -1], self.least[own[i], -1]
        better = np.isfinite(exact) & ((exact > last) | ((exact == last) & (least[j] < least_last)))
        i, j, exact = i[better], j[better], exact[better]
        if not len(i):
            return
        rows, start, n = np.unique(i, return_index=True, return_counts=True)
        put = np.repeat(np.arange(len(rows)), n), w + np.arange(len(i)) - np.repeat(start, n)
        own, shape = own[rows], (len(rows), int(n.max()))
        both = [np.hstack([old[own], np.full(shape, none)]) for old, none in ((self.score, -np.inf), (self.least, np.iinfo(np.int64).max), (self.entry, -1))]
        for table, value in zip(both, (exact, least[j], at + j), strict=True):
            table[put] = value
        order = np.lexsort((both[1], -both[0]), axis=-1)[:, :w]
        self.score[own], self.least[own], self.entry[own] = (np.take_along_axis(t, order, 1) for t in both)


def _search(batches: Iterator[pa.RecordBatch], d: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, ids, score) of a task: its queries come first (their cell is -1 less the first cell of the task), then entries in the order of cells."""
    held, best, ids, at = [], None, [], 0
    for b in batches:
        cell = b.column("cell").to_numpy()
        n = int((cell < 0).sum())
        if n:
            held.append(b.slice(0, n))
        if n == len(cell):
            continue
        if not held:
            return
        if best is None:
            seen = np.vstack([np.frombuffer(x.as_buffer(), np.uint8) for h in held for x in h.column("seen")])
            names = np.concatenate([h.column("ids").flatten().to_numpy() for h in held])
            best = _Best(names, np.vstack([_matrix(h.column("v"), d) for h in held]), seen, -1 - held[0].column("cell")[0].as_py(), top + 1)
        cell, x, own = cell[n:], _matrix(b.column("v").slice(n), d), pa.concat_arrays([b.column("ids").slice(n)])
        some, bounds = own.flatten().to_numpy(), own.offsets.to_numpy() - own.offsets[0].as_py()
        least, alone = some[bounds[:-1]], some[bounds[:-1]] == some[bounds[1:] - 1]
        ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            for a in range(start, end, 1024):
                z = min(end, a + 1024)
                best.look(int(cell[a]), x[a:z], least[a:z], alone[a:z], at + a)
        ids.append(own)
        at += len(cell)
    if best is None:
        return
    ids, names = pa.concat_arrays(ids), best.names
    for a in range(0, len(names), 256):
        entry, score = best.entry[a : a + 256], best.score[a : a + 256]
        found = entry >= 0
        query = np.repeat(names[a : a + 256], found.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(query), ids.take(pa.array(entry[found])), pa.array(score[found])], ["query_id", "ids", "score"])


def nearest(vectors: DataFrame, queries: DataFrame | None = None, top: int = 20, target: float = 0.97, sample: int = 8192, per_block: int = 8192, per_group: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). ``queries``: ids (``vec_id``) of the vectors to search for; all if None."""
    spark = vectors.sparkSession
    vectors = settle(usable(vectors), "vectors")
    index = fit(vectors, top, target, sample)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, k2, kind = index["d"], len(index["c2"]), dict(vectors.dtypes)["v"]
    v = vectors.where(F.size("v") == d)

    # The hash makes for cheap sorting; both windows share an exchange, which a grouping by ``v`` would not.
    by_vector = Window.partitionBy("h", "v").orderBy("vec_id")
    often = v.groupBy(F.xxhash64("v").alias("h"), "v", "vec_id").agg(F.least(F.count("*"), F.lit(top)).cast("int").alias("times"))
    few = often.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= top + 1)
    few = few.withColumn("few", F.collect_list(F.struct("vec_id", "times")).over(by_vector.rowsBetween(0, top))).where("r = 1")
    entries = few.select("v", F.flatten(F.transform("few", lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h1, h2 = _halves(_matrix(b.column("v"), d), index["largest"])
                cell = np.argmin(_near(h1, index["c1"]), 1) * k2 + np.argmin(_near(h2, index["c2"]), 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["v", "ids", "cell"])

    entries = settle(entries.mapInArrow(assign, f"v {kind}, ids array<bigint>, cell int"), "cells")
    counts = np.zeros(len(index["c1"]) * k2, dtype=np.int64)
    for r in entries.groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    # Cells in a row share a block; a cell that is larger than a block has blocks of its own.
    first, parts, block, held = np.zeros(len(counts), int), np.ones(len(counts), int), 0, 0
    for c in np.flatnonzero(counts):
        if counts[c] > per_block:
            block += held > 0
            first[c], parts[c], held = block, -(-counts[c] // per_block), 0
            block += parts[c]
        else:
            if held + counts[c] > per_block:
                block, held = block + 1, 0
            first[c], held = block, held + counts[c]
    wanted, sizes = math.ceil(index["share"] * counts.sum()), counts.tolist()

    asked = v if queries is None else v.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = settle(asked.groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own")), "queries")
    drop(vectors)
    n_asked, blocks = asked.count(), int(block) + int(held > 0)
    groups = max(1, math.ceil(n_asked / per_group))
    # A task is a group of queries and a run of blocks; a run's cells are in a row.
    runs = min(blocks, max(math.ceil(blocks / 8), math.ceil(48 / groups)))
    full = np.flatnonzero(counts)
    lowest = [int(full[np.searchsorted((first + parts - 1)[full] * runs // blocks, r)]) for r in range(runs)]
    highest = [int(full[np.searchsorted(first[full] * runs // blocks, r, "right") - 1]) for r in range(runs)]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            q1, q2 = _halves(_matrix(b.column("v"), d), None)
            d1, d2, own = _near(q1, index["c1"]), _near(q2, index["c2"]), b.column("own").to_pylist()
            seen = np.zeros((b.num_rows, len(sizes)), bool)
            for i in range(len(seen)):
                seen[i, traverse(d1[i], d2[i], sizes, wanted + own[i] - 1)] = True  # its id's other vectors don't count
            for r in range(runs):
                part = seen[:, lowest[r] : highest[r] + 1]
                took = np.flatnonzero(part.any(axis=1))
                if not len(took):
                    continue
                bits, ask = pa.array([x.tobytes() for x in np.packbits(part[took], axis=1)], pa.binary()), pa.array(took)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(ask), b.column("v").take(ask), bits, pa.array(np.full(len(took), r, np.int32)), pa.array(np.full(len(took), -1 - lowest[r], np.int32))], ["query_id", "v", "seen", "run", "cell"])

    probes = asked.select("vec_id", "v", "own").repartition(max(1, math.ceil(n_asked / 256)), "vec_id").mapInArrow(visit, f"query_id long, v {kind}, seen binary, run int, cell int")
    probes = probes.withColumn("grp", F.pmod(F.xxhash64(F.lit(SEED), "query_id"), F.lit(groups)).cast("int"))
    cells = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()], "cell int, at int, parts int")
    placed = entries.join(F.broadcast(cells), "cell").withColumn("run", ((F.col("at") + F.pmod(F.xxhash64("ids"), "parts")) * runs / blocks).cast("int"))
    placed = placed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    task = (F.col("grp") * runs + F.col("run")).alias("task")
    both = probes.select(task, "cell", F.array("query_id").alias("ids"), "v", "seen").union(placed.select(task, "cell", "ids", "v", F.lit(None).cast("binary").alias("seen")))
    dealt = both.repartitionById(groups * runs, "task").sortWithinPartitions("cell").drop("task")
    found = dealt.mapInArrow(lean(lambda batches: _search(batches, d, top)), "query_id long, ids array<bigint>, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.element_at("ids", 1))
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    near = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
