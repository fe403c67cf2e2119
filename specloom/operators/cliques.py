"""Exact marginals of all vertices of many networks at once, by messages in clique trees.

Every model's tree comes from its own structure: vertices are eliminated, the one with fewest neighbours first, the maximal cliques among what each elimination joins are the tree's
nodes, and cliques with the largest separators are linked. That is a small table for each model. The numbers are rows (model_id, clique, vals, p) of all models, whatever
their structures: tables multiply into a clique by a join, messages go up and down level by level, each a sum over a separator and a join with it.

A clique's table grows with the product of its members' values, as exact inference must; ``most`` bounds it, and a model beyond is an error.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

TREE = "model_id string, clique int, members array<string>, above int, separator array<string>, depth int, tables array<string>"


def elimination_cliques(parents: dict[str, list[str]], sizes: dict[str, int]) -> list[frozenset]:
    """Maximal cliques of the triangulated moral graph. Of the vertices with fewest neighbours the one with the smallest table goes first, then by name."""
    near: dict[str, set] = {v: set() for v in parents}
    for v, pa_ in parents.items():
        for a, b in itertools.combinations([v, *pa_], 2):
            near[a].add(b)
            near[b].add(a)
    found: list[frozenset] = []

    def table(v: str) -> int:
        out = sizes[v]
        for x in near[v]:
            out *= sizes[x]
        return out

    while near:
        v = min(near, key=lambda x: (len(near[x]), table(x), x))
        around = near.pop(v)
        clique = frozenset(around | {v})
        if not any(clique <= c for c in found):
            found.append(clique)
        for a in around:
            near[a] = (near[a] | around) - {a, v}
    return found


def rooted_tree(cliques: list[frozenset]) -> list[tuple[int, int]]:
    """(clique above or -1, depth) of each clique: a tree of largest separators, its root in the middle so that it is as flat as it can be."""
    n = len(cliques)
    links: list[set] = [set() for _ in range(n)]
    inside = {0}
    while len(inside) < n:
        i, j = max(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: (len(cliques[e[0]] & cliques[e[1]]), -e[0], -e[1]))
        links[i].add(j)
        links[j].add(i)
        inside.add(j)

    def walk(root: int) -> dict[int, tuple[int, int]]:
        out, todo = {root: (-1, 0)}, [root]
        for i in todo:
            for j in sorted(links[i] - out.keys()):
                out[j] = (i, out[i][1] + 1)
                todo.append(j)
        return out

    far = max(walk(0).items(), key=lambda x: x[1][1])[0]
    ways = walk(far)
    end = max(ways.items(), key=lambda x: x[1][1])[0]
    for _ in range(ways[end][1] // 2):
        end = ways[end][0]
    return [walk(end)[i] for i in range(n)]


def clique_trees(vertices: DataFrame) -> DataFrame:
    """A row for each clique of each model of vertices (model_id, vertex, parents, vals): its sorted members, the clique above it (-1: none), the members that both
    have, its depth, and the vertices whose tables multiply into it."""

    def build(t: pa.Table) -> pa.Table:
        parents = {r["vertex"]: r["parents"] or [] for r in t.select(["vertex", "parents"]).to_pylist()}
        cliques = elimination_cliques(parents, {r["vertex"]: r["n"] for r in t.select(["vertex", "n"]).to_pylist()})
        tree = rooted_tree(cliques)
        home: dict[int, list[str]] = {}
        for v in sorted(parents):
            home.setdefault(next(i for i, c in enumerate(cliques) if {v, *parents[v]} <= c), []).append(v)
        model = t.column("model_id")[0].as_py()
        rows = [(model, i, sorted(c), up, sorted(c & cliques[up]) if up >= 0 else [], depth, home.get(i, [])) for i, (c, (up, depth)) in enumerate(zip(cliques, tree, strict=True))]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TREE.split(", ")])

    return vertices.select("model_id", "vertex", "parents", F.size("vals").alias("n")).groupBy("model_id").applyInArrow(build, TREE)


def _of(members: Column, vals: Column, wanted: Column) -> Column:
    """The values of ``wanted`` members, in its order."""
    return F.transform(wanted, lambda v: F.element_at(vals, F.array_position(members, v).cast("int")))


def _tables(tree: DataFrame, cpt: DataFrame, vals: DataFrame, most: int) -> DataFrame:
    """Rows (model_id, clique, vals, p): products of the tables of each clique, for every combination of its members' values."""
    grid = tree.select("model_id", "clique", F.posexplode("members").alias("i", "vertex")).join(vals, ["model_id", "vertex"])
    grid = grid.groupBy("model_id", "clique").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "vals"))), lambda x: x["vals"]).alias("choices"))
    size = F.aggregate("choices", F.lit(1).cast("long"), lambda a, x: a * F.size(x))
    grow = lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(x, lambda y: F.concat(a, F.array(y)))))
    every = F.aggregate("choices", F.array(F.array().cast("array<string>")), grow)
    grid = grid.select("model_id", "clique", F.explode(F.when(size <= most, every).otherwise(F.raise_error(F.concat(F.lit("a clique's table is too large in "), "model_id")))).alias("vals"))
    rows = grid.join(tree.select("model_id", "clique", "members", "tables"), ["model_id", "clique"])
    parents = cpt.select("model_id", "vertex", "parents").distinct()
    asked = rows.select("model_id", "clique", "vals", "members", F.explode("tables").alias("vertex")).join(parents, ["model_id", "vertex"])
    asked = asked.select("model_id", "clique", "vals", "vertex", _of(F.col("members"), F.col("vals"), F.col("parents")).alias("parent_vals"), F.element_at("vals", F.array_position("members", F.col("vertex")).cast("int")).alias("outcome"))
    met = asked.join(cpt.select("model_id", "vertex", "parent_vals", "outcome", "p"), ["model_id", "vertex", "parent_vals", "outcome"], "left")
    own = met.groupBy("model_id", "clique", "vals").agg(F.product(F.coalesce("p", F.lit(0.0))).alias("p"))
    return grid.join(own, ["model_id", "clique", "vals"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))  # a clique without tables: all ones


def beliefs(cpt: DataFrame, vertices: DataFrame, evidence: DataFrame | None = None, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Clique trees and the joint distribution (model_id, clique, vals, p) of each clique, given ``evidence`` (model_id, vertex, outcome). Sums of a model's
    cliques are the chance of the evidence."""
    cpt, vertices = checkpointed(cpt), checkpointed(vertices.select("model_id", "vertex", "parents", "vals"))
    tree = checkpointed(clique_trees(vertices))
    levels = tree.agg(F.max("depth")).first()[0] or 0
    if evidence is not None:
        seen = evidence.select("model_id", "vertex", F.col("outcome").alias("_seen"))
        cpt = cpt.join(seen, ["model_id", "vertex"], "left").withColumn("p", F.when(F.col("_seen").isNull() | (F.col("_seen") == F.col("outcome")), F.col("p")).otherwise(0.0)).drop("_seen")
    shape = tree.select("model_id", "clique", "members", "above", "separator", "depth")
    p = checkpointed(_tables(tree, cpt, vertices.select("model_id", "vertex", "vals"), most).join(shape, ["model_id", "clique"]))
    cell = ["model_id", "clique", "vals"]
    message = lambda rows: rows.groupBy("model_id", "above", "clique", _of(F.col("members"), F.col("vals"), F.col("separator")).alias("key")).agg(F.sum("p").alias("m"))
    done, sent = None, None
    rows = p.where(F.col("depth") == levels)
    for depth in range(levels, 0, -1):  # up: what a level knows of its separators, multiplied into the level above
        m = checkpointed(message(rows))
        done, sent = rows if done is None else done.unionByName(rows), m if sent is None else sent.unionByName(m)
        into = p.where(F.col("depth") == depth - 1)
        below = shape.where(F.col("depth") == depth).select("model_id", F.col("above").alias("clique"), F.col("clique").alias("child"), F.col("separator").alias("s"))
        asked = into.join(below, ["model_id", "clique"]).select(*cell, "child", _of(F.col("members"), F.col("vals"), F.col("s")).alias("key"))
        told = asked.join(m.select("model_id", F.col("clique").alias("child"), "key", "m"), ["model_id", "child", "key"]).groupBy(*cell).agg(F.product("m").alias("m"))
        rows = checkpointed(into.join(told, cell, "left").withColumn("p", F.col("p") * F.coalesce("m", F.lit(1.0))).drop("m"))
    whole = rows if done is None else done.unionByName(rows)
    out = rows.select(*cell, "p")
    above = rows
    for depth in range(1, levels + 1):  # down: what the level above knows besides what it was told from here
        own = whole.where(F.col("depth") == depth).withColumn("key", _of(F.col("members"), F.col("vals"), F.col("separator")))
        below = shape.where(F.col("depth") == depth).select("model_id", F.col("clique").alias("child"), F.col("above").alias("clique"), F.col("separator").alias("s"))
        known = above.join(below, ["model_id", "clique"]).groupBy("model_id", "child", _of(F.col("members"), F.col("vals"), F.col("s")).alias("key")).agg(F.sum("p").alias("b"))
        ratio = known.join(sent.select("model_id", F.col("clique").alias("child"), "key", "m"), ["model_id", "child", "key"]).select("model_id", F.col("child").alias("clique"), "key", F.when(F.col("m") > 0, F.col("b") / F.col("m")).otherwise(0.0).alias("r"))
        above = checkpointed(own.join(ratio, ["model_id", "clique", "key"]).withColumn("p", F.col("p") * F.col("r")).drop("r", "key"))
        out = out.unionByName(above.select(*cell, "p"))
    return tree, out


def exact_marginals(cpt: DataFrame, vertices: DataFrame, evidence: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """Rows (model_id, vertex, outcome, p) for all vertices: exact, given ``evidence``; null if the evidence can't be."""
    tree, b = beliefs(cpt, vertices, evidence, most)
    first = tree.select("model_id", F.explode("members").alias("vertex"), "clique").groupBy("model_id", "vertex").agg(F.min("clique").alias("clique"))
    rows = b.join(tree.select("model_id", "clique", "members"), ["model_id", "clique"]).join(first, ["model_id", "clique"])
    n = rows.groupBy("model_id", "vertex", F.element_at("vals", F.array_position("members", F.col("vertex")).cast("int")).alias("outcome")).agg(F.sum("p").alias("p"))
    total = F.sum("p").over(Window.partitionBy("model_id", "vertex"))
    return n.withColumn("p", F.when(total > 0, F.col("p") / total))
