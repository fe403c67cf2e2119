"""Ancestral sampling from a network, reproducible: uniforms are digests of (seed, sample, vertex)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def chosen(cdf: Column, u: Column) -> Column:
    """The first outcome whose cumulative probability is above ``u``; the last one if rounding leaves none."""
    above = F.filter(cdf, lambda x: x["c"] > u)
    return F.when(F.size(above) > 0, F.element_at(above, 1)["outcome"]).otherwise(F.element_at(cdf, -1)["outcome"])


def normal(*key: Column) -> Column:
    """A standard normal number from two uniforms of the key (Box-Muller); the logarithm's argument is never 0."""
    u, v = uniform(*key, F.lit("u")), uniform(*key, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def gaussian(mean: Column, variance: Column, z: Column, terms: list[tuple[Column, Column]] = ()) -> Column:
    """A draw of a linear Gaussian node: its mean, which grows by factor * parent for ``terms``, and the root of its variance times ``z``."""
    for factor, parent in terms:
        mean = mean + factor * parent
    return mean + F.sqrt(variance) * z


def ancestral(cpt: DataFrame, ids: DataFrame, order: list[tuple[str, list[str]]], seed: int = 0, evidence: dict[str, str] | None = None, most_rows: int = 100_000) -> DataFrame:
    """A row for each of ``ids`` (model_id, sample, sample_key): a column for each vertex, in topological ``order`` of (vertex, parents). A vertex of ``evidence``
    has that value, and what follows it is drawn given it; what comes before it is not conditioned."""
    up = Window.partitionBy("model_id", "vertex", "parent_vals").orderBy("outcome_idx")
    c = cpt.withColumn("c", F.sum("p").over(up))
    key = F.concat_ws("|", "vertex", F.array_join("parent_vals", "|"))
    c = c.groupBy("model_id", key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("outcome_idx", "c", "outcome"))).alias("cdf"))
    c = checkpointed(c)
    if c.count() > most_rows:  # too many networks for a row each that every task has: one join per vertex
        return _by_joins(c, ids, order, seed, evidence or {})
    # A broadcast row per vertex and parents' values, met by its hash: samples are never shuffled, and a draw costs the same however large a network is.
    rows = F.broadcast(c.select("model_id", F.col("key").alias("_key"), "cdf"))
    out = ids.join(F.broadcast(c.select("model_id").distinct()), "model_id", "left_semi")
    for vertex, parents in order:
        if vertex in (evidence or {}):
            out = out.withColumn(vertex, F.lit(evidence[vertex]))
            continue
        u = uniform(F.lit(str(seed)), F.col("sample_key"), F.lit(vertex))
        out = out.withColumn("_key", _row_of(vertex, parents)).join(rows, ["model_id", "_key"], "left").withColumn(vertex, chosen(F.col("cdf"), u)).drop("_key", "cdf")
    return out


def _row_of(vertex: str, parents: list[str]) -> Column:
    return F.concat_ws("|", F.lit(vertex), F.concat_ws("|", *parents) if parents else F.lit(""))


def _by_joins(c: DataFrame, ids: DataFrame, order: list[tuple[str, list[str]]], seed: int, evidence: dict[str, str]) -> DataFrame:
    out = ids
    for vertex, parents in order:
        if vertex in evidence:
            out = out.withColumn(vertex, F.lit(evidence[vertex]))
            continue
        own = c.select("model_id", F.col("key").alias("_key"), "cdf")
        u = uniform(F.lit(str(seed)), F.col("sample_key"), F.lit(vertex))
        out = out.withColumn("_key", _row_of(vertex, parents)).join(own, ["model_id", "_key"]).withColumn(vertex, chosen(F.col("cdf"), u)).drop("_key", "cdf")
    return out


def _around(vertex: str, order: list[tuple[str, list[str]]]) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """What a vertex's draw depends on: its parents, its children and their other parents; and the children with their parents."""
    children = [(v, pa) for v, pa in order if vertex in pa]
    near = [*dict(order)[vertex], *(x for v, pa in children for x in (v, *pa))]
    return [x for x in dict.fromkeys(near) if x != vertex], children


def _conditionals(cpt: DataFrame, order: list[tuple[str, list[str]]], drawn: list[str]) -> DataFrame:
    """Rows (model_id, _key, cdf): for each vertex of ``drawn`` and each combination of what is around it the values' cumulated weights (c, x), where a weight is the value's own
    probability times those of the children given it. A combination for which the tables lack a probability has no row."""

    def factor(vertex: str, parents: list[str], p: str) -> DataFrame:
        t = cpt.where((F.col("vertex") == vertex) & (F.size("parent_vals") == len(parents)))
        return t.select("model_id", *(F.get("parent_vals", i).alias(x) for i, x in enumerate(parents)), F.col("outcome").alias(vertex), F.col("p").alias(p), *([F.col("outcome_idx").alias("_idx")] if p == "_p" else []))

    sizes = cpt.groupBy("model_id", F.col("vertex").alias("_vertex")).agg(F.countDistinct("outcome").alias("_n"))
    none, found = F.array().cast("array<struct<c:double,x:string>>"), []
    for vertex in drawn:
        around, children = _around(vertex, order)
        t, w = factor(vertex, dict(order)[vertex], "_p"), F.col("_p")
        for i, (child, parents) in enumerate(children):
            f = factor(child, parents, f"_p{i}")
            t, w = t.join(f, [x for x in f.columns if x in t.columns]), w * F.col(f"_p{i}")
        key = F.concat_ws("|", F.lit(vertex), *around)
        each = t.groupBy("model_id", key.alias("_key")).agg(F.array_sort(F.collect_list(F.struct("_idx", F.col(vertex).alias("x"), w.alias("w")))).alias("each"))
        each = each.withColumn("_vertex", F.lit(vertex)).join(F.broadcast(sizes), ["model_id", "_vertex"]).where(F.size("each") == F.col("_n"))
        cdf = F.aggregate("each", none, lambda a, e: F.concat(a, F.array(F.struct((F.coalesce(F.get(a, F.size(a) - 1)["c"], F.lit(0.0)) + e["w"]).alias("c"), e["x"].alias("x")))))
        found.append(each.select("model_id", "_key", cdf.alias("cdf")))
    return reduce(DataFrame.union, found)


def gibbs(cpt: DataFrame, ids: DataFrame, order: list[tuple[str, list[str]]], sweeps: int, evidence: dict[str, str], seed: int = 0, most_rows: int = 100_000) -> DataFrame:
    """The state of a chain for each of ``ids`` after ``sweeps`` sweeps of Gibbs sampling given ``evidence``: from an ancestral draw on, each other vertex in
    turn is drawn given its parents and children. Chains are rows, independent of each other, and never shuffled: a draw looks its weights up in a broadcast table of all
    combinations around the vertex. Where these could be more than ``most_rows`` every row computes its weights from a network's tables.
    If no value has a chance the vertex keeps its own."""
    drawn = [v for v, _ in order if v not in evidence]
    values = cpt.groupBy("model_id", "vertex").agg(F.countDistinct("outcome").alias("n"))
    most = {r.vertex: r for r in values.groupBy("vertex").agg(F.max("n").alias("n"), F.count("*").alias("models")).where(F.col("vertex").isin([v for v, _ in order])).collect()}
    if not drawn or any(v not in most for v, _ in order) or sum(most[v].models * math.prod(most[x].n for x in [v, *_around(v, order)[0]]) for v in drawn) > most_rows:
        return _gibbs_in_rows(cpt, ids, order, sweeps, evidence, seed)
    rows = F.broadcast(checkpointed(_conditionals(cpt, order, drawn)))
    out = ancestral(cpt, ids, order, seed, evidence)
    for sweep in range(sweeps):
        for vertex in drawn:
            goal = F.element_at("cdf", -1)["c"] * uniform(F.lit(str(seed)), F.col("sample_key"), F.lit(vertex), F.lit(str(sweep)))
            out = out.withColumn("_key", F.concat_ws("|", F.lit(vertex), *_around(vertex, order)[0])).join(rows, ["model_id", "_key"], "left").withColumn("_goal", goal)
            pick = F.get(F.filter("cdf", lambda x: x["c"] > F.col("_goal")), 0)["x"]
            out = out.withColumn(vertex, F.coalesce(pick, F.col(vertex))).drop("_key", "_goal", "cdf")
        out = checkpointed(out)  # joins of one sweep only
    return out


def _gibbs_in_rows(cpt: DataFrame, ids: DataFrame, order: list[tuple[str, list[str]]], sweeps: int, evidence: dict[str, str], seed: int) -> DataFrame:
    """``gibbs`` for networks with too many combinations around a vertex for a table: a network's tables are one row, joined to each chain."""
    values = cpt.groupBy("model_id", "vertex").agg(F.array_sort(F.collect_set(F.struct("outcome_idx", "outcome"))).alias("v"))
    values = values.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("vertex", F.col("v.outcome").alias("v")))).alias("_vals"))
    p = cpt.select("model_id", F.concat_ws("|", "vertex", F.array_join("parent_vals", "|"), "outcome").alias("key"), "p")
    p = p.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "p"))).alias("_p"))
    out = ancestral(cpt, ids, order, seed, evidence).join(F.broadcast(checkpointed(values.join(p, "model_id"))), "model_id")
    for sweep in range(sweeps):
        for vertex, parents in order:
            if vertex in evidence:
                continue

            def weight(x: Column, vertex: str = vertex, parents: list[str] = parents) -> Column:
                w = F.element_at("_p", F.concat_ws("|", _row_of(vertex, parents), x))
                for child, theirs in order:
                    if vertex in theirs:
                        given = F.concat_ws("|", *[x if t == vertex else F.col(t) for t in theirs])
                        w = w * F.element_at("_p", F.concat_ws("|", F.lit(child), given, F.col(child)))
                return w

            each = F.transform(F.element_at("_vals", F.lit(vertex)), lambda x: F.struct(weight(x).alias("w"), x.alias("x")))
            total = F.aggregate(each, F.lit(0.0), lambda a, e: a + e["w"])
            goal = total * uniform(F.lit(str(seed)), F.col("sample_key"), F.lit(vertex), F.lit(str(sweep)))
            start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("x"))
            pick = F.aggregate(each, start, lambda a, e: F.when(a["x"].isNotNull(), a).otherwise(F.struct((a["s"] + e["w"]).alias("s"), F.when(a["s"] + e["w"] > goal, e["x"]).alias("x"))))  # noqa: B023
            out = out.withColumn(vertex, F.coalesce(pick["x"], F.col(vertex)))
        out = checkpointed(out)  # expressions of one sweep only
    return out.drop("_vals", "_p")
