"""State paths below a mean-weight threshold, and the best ones.

A path leads over the weighted edges of a state graph; edges from ``start`` and into ``terminal`` have no weight and don't count.
Prefixes that can't end below the threshold are dropped: for each state and number of further edges the least remaining
weight is known from a backward pass. The bound has a small slack for sums of floats; the threshold itself is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import signal_of
from ..sources.tables import checkpointed
from .network import START, TERMINAL

SLACK = 1e-12


def _least_rest(w: DataFrame, leaves: DataFrame, levels: int) -> DataFrame:
    """Rows (model_id, v, val, rest): the least remaining weight for each number of edges to a last vertex, as (k, m)."""
    now = leaves.select("model_id", "v", "val", F.lit(0).alias("k"), F.lit(0.0).alias("m"))
    every = now
    for k in range(1, levels + 1):
        ahead = now.select("model_id", F.col("v").alias("dst"), F.col("val").alias("dst_val"), "m")
        now = checkpointed(w.join(ahead, ["model_id", "dst", "dst_val"]).groupBy("model_id", F.col("src").alias("v"), F.col("src_val").alias("val")).agg(F.lit(k).alias("k"), F.min(F.col("w") + F.col("m")).alias("m")))
        every = every.union(now)
    return checkpointed(every.groupBy("model_id", "v", "val").agg(F.collect_list(F.struct("k", "m")).alias("rest")))


def _ends(boundary: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = boundary.where(F.col("src") == START).select("model_id", F.col("dst").alias("v"))
    last = boundary.where(F.col("dst") == TERMINAL).select("model_id", F.col("src").alias("v"))
    return states.join(first, ["model_id", "v"], "left_semi"), states.join(last, ["model_id", "v"], "left_semi")


def below(weights: DataFrame, boundary: DataFrame, states: DataFrame, theta: float, levels: int, min_length: int = 2, min_signals: int = 1) -> DataFrame:
    """Rows (model_id, nodes, tokens, metric): all paths with mean weight <= 1 - theta. ``nodes``: (v, val) structs; ``states``: (model_id, v, val)."""
    w = checkpointed(weights.select("model_id", "src", "src_val", "dst", "dst_val", "w"))
    roots, leaves = _ends(boundary, states)
    roots, leaves = checkpointed(roots), checkpointed(leaves)
    rest, limit = _least_rest(w, leaves, levels), 1 - theta
    node = F.struct("v", "val")
    now = roots.select("model_id", "v", "val", F.array(node).alias("nodes"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    found = None
    for level in range(levels + 1):
        if level:
            step = now.select("model_id", F.col("v").alias("src"), F.col("val").alias("src_val"), "nodes", "n", "s").join(w, ["model_id", "src", "src_val"])
            now = step.select("model_id", F.col("dst").alias("v"), F.col("dst_val").alias("val"), F.concat("nodes", F.array(F.struct(F.col("dst").alias("v"), F.col("dst_val").alias("val")))).alias("nodes"), (F.col("n") + 1).alias("n"), (F.col("s") + F.col("w")).alias("s"))
        can = F.exists("rest", lambda r: F.col("s") + r["m"] <= limit * (F.col("n") + r["k"]) + SLACK)
        now = checkpointed(now.join(rest, ["model_id", "v", "val"]).where(can).drop("rest"))
        done = now.join(leaves, ["model_id", "v", "val"], "left_semi").where("n > 0").select("model_id", "nodes", (F.col("s") / F.col("n")).alias("metric"))
        found = done if found is None else found.union(done)
    signals = F.size(F.array_distinct(F.transform("nodes", lambda x: signal_of(x["v"]))))
    tokens = F.transform("nodes", lambda x: F.concat_ws(":", signal_of(x["v"]), x["val"]))
    return found.where((F.col("metric") <= limit) & (F.size("nodes") >= min_length) & (signals >= min_signals)).withColumn("tokens", tokens)


def numbered(found: DataFrame) -> DataFrame:
    """Adds ``path_id``: the place of a path in its model by metric."""
    order = Window.partitionBy("model_id").orderBy("metric", F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["v"], x["val"])), ","))
    return found.withColumn("path_id", F.row_number().over(order) - 1)


def best(weights: DataFrame, boundary: DataFrame, states: DataFrame, levels: int) -> DataFrame:
    """Rows (model_id, n_edges, metric): the least mean weight of a path for each number of edges."""
    w = checkpointed(weights.select("model_id", "src", "src_val", "dst", "dst_val", "w"))
    roots, leaves = _ends(boundary, states)
    least = _least_rest(w, checkpointed(leaves), levels)
    at_root = roots.join(least, ["model_id", "v", "val"]).select("model_id", F.explode("rest").alias("r")).where("r.k > 0")
    return at_root.groupBy("model_id", F.col("r.k").alias("n_edges")).agg(F.min(F.col("r.m") / F.col("r.k")).alias("metric"))


STATE = ["model_id", "v", "val"]


def _k_tables(weights: DataFrame, roots: DataFrame, levels: int, k: int) -> list[DataFrame]:
    """For each number of edges a table (model_id, v, val, rank, s, from_v, from_val, from_rank): the ``k`` least sums of ways from a root to each state, and which row of
    the table before each comes from. Sums that agree to 12 places are ordered by where they come from."""
    one = F.lit(1)
    out = [checkpointed(roots.select(*STATE, one.alias("rank"), F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("from_v"), F.lit(None).cast("string").alias("from_val"), F.lit(None).cast("int").alias("from_rank")))]
    order = Window.partitionBy(*STATE).orderBy(F.round("s", 12), "from_v", "from_val", "from_rank")
    for _ in range(levels):
        last = out[-1].select("model_id", F.col("v").alias("src"), F.col("val").alias("src_val"), F.col("rank").alias("from_rank"), "s")
        ways = last.join(weights, ["model_id", "src", "src_val"]).select("model_id", F.col("dst").alias("v"), F.col("dst_val").alias("val"), (F.col("s") + F.col("w")).alias("s"), F.col("src").alias("from_v"), F.col("src_val").alias("from_val"), "from_rank")
        out.append(checkpointed(ways.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*out[0].columns)))
    return out


def k_best(weights: DataFrame, boundary: DataFrame, states: DataFrame, levels: int, k: int, by_length: bool = False) -> DataFrame:
    """Rows (model_id, place, n_edges, metric, nodes): the ``k`` paths of least mean weight in each model (``by_length``: for each number of edges), best first.

    A path of the result goes through one of the k least sums of its state and length at every step, so tables of k rows for a state and length hold
    all that is needed; paths are put together at the end, from their last state back, a join for each step.
    """
    w = checkpointed(weights.select("model_id", "src", "src_val", "dst", "dst_val", "w"))
    roots, leaves = _ends(boundary, states)
    tables, leaves = _k_tables(w, roots, levels, k), checkpointed(leaves)
    ends = None
    for n, t in enumerate(tables[1:], 1):
        e = t.join(leaves, STATE, "left_semi").select(*STATE, "rank", F.lit(n).alias("n_edges"), (F.col("s") / n).alias("metric"))
        ends = e if ends is None else ends.union(e)
    if ends is None:
        raise ValueError("paths have an edge at least: levels must be 1 or more")
    order = Window.partitionBy("model_id", *(["n_edges"] if by_length else [])).orderBy(F.round("metric", 12), "n_edges", "v", "val", "rank")
    now = checkpointed(ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("nodes", F.array(F.struct("v", "val"))))
    for n in range(levels, 0, -1):
        step = tables[n].select(*STATE, "rank", "from_v", "from_val", "from_rank")
        moved = now.where(F.col("n_edges") >= n).join(step, [*STATE, "rank"])
        moved = moved.select("model_id", F.col("from_v").alias("v"), F.col("from_val").alias("val"), F.col("from_rank").alias("rank"), "n_edges", "metric", "place", F.concat(F.array(F.struct(F.col("from_v").alias("v"), F.col("from_val").alias("val"))), "nodes").alias("nodes"))
        now = checkpointed(moved.unionByName(now.where(F.col("n_edges") < n)))
    return now.select("model_id", "place", "n_edges", "metric", "nodes")
