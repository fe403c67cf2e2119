"""Reduced ordered decision diagrams of boolean functions, many functions at once.

A diagram is a table of nodes (id, variable, low, high), shared by all functions, and a table of roots (fn, id). A node's id is its variable (two
digits) and a digest of its variable and children, so equal subfunctions are one node wherever they come from, and two functions are equal exactly
if their roots are. ``FALSE`` and ``TRUE`` are the ends. No node has equal children. Variables are numbered in their order, from 0; a diagram has at most
``MOST`` of them, while a truth table doubles with each.

An assignment is a number: its variables' bits, variable 0 highest. Rows with a null function or assignment take no part, repeated rows count once. A function
without any row has no root here; ``applied`` and ``counted`` take the root ``FALSE`` for it. Work is by levels: rows that share a beginning
meet, at most two at a level, and a key that rows are dealt by has at most 2 ** ``STRIDE`` of them, whatever the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

FALSE, TRUE = "99:0", "99:1"
MOST = 62
STRIDE = 6

_NODE = "array<struct<id: string, variable: int, low: string, high: string>>"


def _id(variable: Column, low: Column, high: Column) -> Column:
    """The id of a node with these children: a child where both are the same."""
    named = F.concat(F.lpad(variable.cast("string"), 2, "0"), F.lit(":"), F.md5(F.concat_ws("|", variable.cast("string"), low, high)))
    return F.when(low == high, low).otherwise(named)


def _level(node: Column) -> Column:
    return F.substring(node, 1, 2).cast("int")


def assignment(variables: list[Column]) -> Column:
    """Boolean columns as a number, the first one highest; null where any of them is."""
    if len(variables) > MOST:
        raise ValueError(f"at most {MOST} variables")
    return reduce(lambda bits, v: bits * 2 + v.cast("bigint"), variables, F.lit(0).cast("bigint"))


def built(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots of the functions that are true at their rows (fn, assignment) and false elsewhere.

    A round takes ``STRIDE`` variables away, the last ones first. It deals rows by what is left of their assignment, so its levels need no shuffle of their own, and
    a key has at most 2 ** STRIDE rows.
    """
    if not 0 <= n <= MOST:
        raise ValueError(f"0 to {MOST} variables")
    at = rows.where("fn IS NOT NULL AND assignment IS NOT NULL").select("fn", F.col("assignment").cast("bigint").alias("at")).distinct().withColumn("node", F.lit(TRUE))
    at, nodes = checkpointed(at), []
    for last in range(n, 0, -STRIDE):
        first = max(0, last - STRIDE)
        level = at.withColumn("top", F.shiftright("at", last - first)).repartition("fn", "top").withColumn("made", F.array().cast(_NODE))
        for variable in range(last - 1, first - 1, -1):
            half = lambda bit: F.coalesce(F.max(F.when(F.col("at").bitwiseAND(1) == bit, F.col("node"))), F.lit(FALSE))
            level = level.groupBy("fn", "top", F.shiftright("at", 1).alias("up")).agg(half(0).alias("low"), half(1).alias("high"), F.flatten(F.collect_list("made")).alias("made"))
            level = level.withColumn("node", _id(F.lit(variable), F.col("low"), F.col("high")))
            new = F.array(F.struct(F.col("node").alias("id"), F.lit(variable).alias("variable"), "low", "high")).cast(_NODE)
            made = F.when(F.col("low") == F.col("high"), F.col("made")).otherwise(F.array_union("made", new))
            level = level.select("fn", "top", F.col("up").alias("at"), "node", made.alias("made"))
        level = checkpointed(level.select("fn", "at", "node", "made"))
        nodes.append(level.select(F.explode("made").alias("x")).select("x.*"))
        at = level.drop("made")
    none = at.select(F.col("node").alias("id"), F.lit(0).alias("variable"), F.col("node").alias("low"), F.col("node").alias("high")).limit(0)
    return checkpointed(reduce(DataFrame.union, nodes, none).distinct()), at.select("fn", F.col("node").alias("id"))


def counted(nodes: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """Rows (fn, n_true): at how many of the 2 ** n assignments a function is true, as a decimal(38, 0).

    The weight of a root goes down the diagram, half to each child, and is summed where ways meet; what comes to ``TRUE`` is the share of true assignments. Weights
    are whole numbers of assignments, so the count is exact.
    """
    front = roots.select("fn", "id", F.lit(2**n).cast("decimal(38,0)").alias("w"))
    for variable in range(n):
        here = F.col("variable") == variable
        children = front.join(nodes.where(here), "id", "left")
        child = F.when(F.col("variable").isNull(), F.array(F.struct("id", "w"))).otherwise(F.transform(F.array("low", "high"), lambda c: F.struct(c.alias("id"), (F.col("w") / 2).cast("decimal(38,0)").alias("w"))))
        front = children.select("fn", F.explode(child).alias("c")).groupBy("fn", F.col("c.id").alias("id")).agg(F.sum("c.w").cast("decimal(38,0)").alias("w"))
        if variable % STRIDE == STRIDE - 1:
            front = checkpointed(front)
    return front.groupBy("fn").agg(F.coalesce(F.sum(F.when(F.col("id") == TRUE, F.col("w"))), F.lit(0)).cast("decimal(38,0)").alias("n_true"))


def _settled(op: Column, a: Column, b: Column) -> Column:
    """The result where it is plain from the two nodes; null where their children decide."""
    bit = lambda x: x == TRUE
    ends = a.startswith("99:") & b.startswith("99:")
    value = F.when(op == "and", bit(a) & bit(b)).when(op == "or", bit(a) | bit(b)).otherwise(bit(a) != bit(b))
    absorbed = F.when((op == "and") & ((a == FALSE) | (b == FALSE)), FALSE).when((op == "or") & ((a == TRUE) | (b == TRUE)), TRUE)
    same = F.when(a == b, F.when(op == "xor", FALSE).otherwise(a))
    return F.coalesce(F.when(ends, F.when(value, TRUE).otherwise(FALSE)), absorbed, same)


def applied(nodes: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots of ``wanted`` (fn, op, a, b): ``and``, ``or`` or ``xor`` of the functions with the roots a and b, all at once.

    Down: the pairs of nodes that are met, ``STRIDE`` levels a round, each once for an operator however many functions ask for it. Up: their results, level by
    level, joined from those of their children's pairs. Pairs are at most the product of both diagrams' sizes, never of their assignments.
    """
    low = nodes.select(F.col("id").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    level = F.least(_level(F.col("a")), _level(F.col("b")))
    unsettled = _settled(F.col("op"), F.col("a"), F.col("b")).isNull()

    def opened(pairs: DataFrame, variable: int) -> DataFrame:
        """With the pairs of both children, for the pairs at a level."""
        at = low.where(_level(F.col("x")) == variable)
        both = pairs.withColumn("here", level == variable).join(at.toDF("a", "al", "ah"), "a", "left").join(at.toDF("b", "bl", "bh"), "b", "left")
        kid = lambda side: [F.coalesce(f"a{side}", "a").alias(f"a{side}"), F.coalesce(f"b{side}", "b").alias(f"b{side}")]
        return both.select("op", "a", "b", "here", *kid("l"), *kid("h"))

    front, levels = checkpointed(wanted.select("op", "a", "b").distinct()), {}
    for first in range(0, n, STRIDE):
        last = min(n, first + STRIDE)
        for variable in range(first, last):
            pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
            kept = F.when(F.col("here"), F.array(pair("a", "b"), pair("al", "bl"), pair("ah", "bh"))).otherwise(F.array(pair("a", "b")))
            front = opened(front.where(unsettled), variable).select("op", F.explode(kept).alias("p")).select("op", "p.*").distinct()
        front = checkpointed(front)
        levels |= {variable: opened(front.where(unsettled & (level == variable)), variable).drop("here") for variable in range(first, last)}
        front = front.where(level >= last)
    results = front.limit(0).withColumn("r", F.lit(FALSE))
    made = []
    for variable in range(n - 1, -1, -1):
        pairs = levels[variable]
        of = lambda s: results.select("op", F.col("a").alias(f"a{s}"), F.col("b").alias(f"b{s}"), F.col("r").alias(f"r{s}"))
        both = pairs.join(of("l"), ["op", "al", "bl"], "left").join(of("h"), ["op", "ah", "bh"], "left")
        child = lambda s: F.coalesce(_settled(F.col("op"), F.col(f"a{s}"), F.col(f"b{s}")), F.col(f"r{s}")).alias(s)
        done = checkpointed(both.select("op", "a", "b", child("l"), child("h")).withColumn("r", _id(F.lit(variable), F.col("l"), F.col("h"))))
        made.append(done.where("l <> h").select(F.col("r").alias("id"), F.lit(variable).alias("variable"), F.col("l").alias("low"), F.col("h").alias("high")))
        results = results.union(done.select("op", "a", "b", "r"))
    root = F.coalesce(_settled(F.col("op"), F.col("a"), F.col("b")), F.col("r")).alias("id")
    roots = wanted.join(results, ["op", "a", "b"], "left").select("fn", root)
    return checkpointed(reduce(DataFrame.union, [nodes.select("id", "variable", "low", "high"), *made]).distinct()), checkpointed(roots)


def reached(nodes: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """Rows (fn, id, variable): the nodes of each function, without the ends."""
    front, found = roots.select("fn", "id"), []
    for first in range(0, n, STRIDE):
        last = min(n, first + STRIDE)
        for variable in range(first, last):
            with_children = front.join(nodes.where(F.col("variable") == variable), "id", "left")
            front = with_children.select("fn", F.explode(F.when(F.col("variable").isNull(), F.array("id")).otherwise(F.array("id", "low", "high"))).alias("id")).distinct()
        front = checkpointed(front)
        level = _level(F.col("id"))
        found.append(front.where(level < last).select("fn", "id", level.alias("variable")))
        front = front.where(level >= last)
    none = roots.select("fn", "id", F.lit(0).alias("variable")).limit(0)
    return reduce(DataFrame.union, found, none)


def equal_pairs(roots: DataFrame) -> DataFrame:
    """Rows (fn, same_as): every function with the first one (by name) that it equals."""
    first = roots.groupBy("id").agg(F.min("fn").alias("same_as"))
    return roots.join(first, "id").select("fn", "same_as")
