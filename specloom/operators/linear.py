"""Linear-time logic and CTL* over a transition table: a tableau product as joins.

Path formulas are nested tuples over X, F, G, U, R, W and the boolean operators, state formulas those of ``logic`` and ("A", f), ("E", f). To find the
states from which some way satisfies a formula, every state is paired with each set of promises (subformulas that hold from the next state on). The
truth of all subformulas at a pair is a column; the promises that a pair's predecessors must have made are its truths of the promised formulas, so
steps of the product are one equi-join on (state, promises). A way satisfies the formula if it leads from a pair where that is true to a strong
component that keeps every until.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .graphs import reachable, reversed_graph, strong_components
from .logic import TRUE, Kripke

STATE_OPERATORS = ("EX", "EU", "EG", "EF", "AX", "AF", "AG", "AU", "ER", "AR", "EW", "AW")


def plain(f):
    """The same path formula in terms of not, or, X and U."""
    if isinstance(f, str) or f == TRUE:
        return f
    op, *args = f
    no = lambda x: x[1] if not isinstance(x, str) and x[0] == "not" else ("not", x)
    if op not in ("not", "or", "X", "U", "and", "imply", "F", "G", "R", "W"):
        raise TypeError(f"{op} is no operator of path formulas")
    a, b = ([plain(x) for x in args] + [None])[:2]
    if op in ("not", "or", "X", "U"):
        return no(a) if op == "not" else (op, a) if b is None else (op, a, b)
    always = lambda x: no(("U", TRUE, no(x)))
    return {
        "and": lambda: no(("or", no(a), no(b))), "imply": lambda: ("or", no(a), b), "F": lambda: ("U", TRUE, a), "G": lambda: always(a),
        "R": lambda: no(("U", no(a), no(b))), "W": lambda: ("or", ("U", a, b), always(a)),
    }[op]()


def _parts(f, op: str) -> list:
    """Different subformulas that start with ``op``, inner ones first."""
    if isinstance(f, str) or f == TRUE:
        return []
    return list(dict.fromkeys([x for g in f[1:] for x in _parts(g, op)] + ([f] if f[0] == op else [])))


def names(f) -> list[str]:
    if isinstance(f, str):
        return [f]
    return list(dict.fromkeys(n for g in f[1:] for n in names(g))) if f != TRUE else []


def some_way(k: Kripke, f) -> DataFrame:
    """States (state) from which some way satisfies the path formula ``f``."""
    f = plain(f)
    untils = _parts(f, "U")
    promised = [x[1] for x in _parts(f, "X")] + untils  # formulas that may be promised for the next state
    bit = {p: i for i, p in enumerate(promised)}
    aps = names(f)
    has = k.labels.where(F.col("ap").isin(aps)).groupBy("state").agg(F.collect_set("ap").alias("aps"))
    pairs = k.states.join(has, "state", "left").withColumn("aps", F.coalesce("aps", F.array().cast("array<string>")))
    pairs = pairs.withColumn("made", F.explode(F.sequence(F.lit(0), F.lit((1 << len(promised)) - 1))))

    def kept(p) -> Column:
        return F.col("made").bitwiseAND(F.lit(1 << bit[p])) != 0

    def truth(g) -> Column:
        if g == TRUE:
            return F.lit(True)
        if isinstance(g, str):
            return F.array_contains("aps", g)
        op, *args = g
        if op == "not":
            return ~truth(args[0])
        if op == "or":
            return truth(args[0]) | truth(args[1])
        if op == "X":
            return kept(args[0])
        return truth(args[1]) | (truth(args[0]) & kept(g))

    asked = reduce(lambda a, x: a + F.when(truth(x[1]), F.lit(1 << x[0])).otherwise(F.lit(0)), enumerate(promised), F.lit(0))
    # An until is kept at a pair where it is false or its goal is reached.
    met = [(~truth(u) | truth(u[2])).alias(f"met{i}") for i, u in enumerate(untils)]
    pairs = checkpointed(pairs.select("state", "made", asked.alias("asked"), truth(f).alias("holds"), *met, F.concat_ws("#", "state", "made").alias("node")))
    ahead = pairs.select(F.col("state").alias("dst"), F.col("asked").alias("made"), F.col("node").alias("to"))
    steps = k.transitions.select(F.col("src").alias("state"), "dst").join(pairs.select("state", "made", "node"), "state").join(ahead, ["dst", "made"])
    steps = checkpointed(steps.select(F.col("node").alias("src"), F.col("to").alias("dst")))
    parts = checkpointed(strong_components(steps))
    inside = pairs.join(parts, "node").groupBy("component").agg(F.count("*").alias("n"), *[F.max(f"met{i}").alias(f"met{i}") for i in range(len(untils))])
    loops = steps.where("src = dst").join(parts, F.col("src") == F.col("node")).select("component", F.lit(True).alias("loop")).distinct()
    live = inside.join(loops, "component", "left").where((F.col("n") > 1) | F.col("loop"))
    for i in range(len(untils)):
        live = live.where(f"met{i}")
    seeds = parts.join(live, "component", "left_semi").select("node")
    good = reachable(reversed_graph(steps), seeds)
    return pairs.where("holds").join(good, "node", "left_semi").select("state").distinct()


def every_way(k: Kripke, f) -> DataFrame:
    """States from which all ways satisfy the path formula ``f``."""
    return k.states.join(some_way(k, ("not", f)), "state", "left_anti")


def check(k: Kripke, f) -> DataFrame:
    """States that satisfy a CTL* state formula: inner quantified formulas become labels of their own, from the inside out."""
    return _check(k, f, {})[0]


def _named(k: Kripke, f, known: dict):
    """The formula with every quantified subformula replaced by a new name, and the structure with these names as labels."""
    if isinstance(f, str) or f == TRUE:
        return k, f
    op, *args = f
    if op not in ("A", "E", *STATE_OPERATORS):
        out = []
        for x in args:
            k, y = _named(k, x, known)
            out.append(y)
        return k, (op, *out)
    if f not in known:
        sat, k = _check(k, f, known)
        known[f] = f"sub#{len(known)}"
        k = Kripke(k.states, k.transitions, checkpointed(k.labels.union(sat.select("state", F.lit(known[f]).alias("ap")))))
    return k, known[f]


def _check(k: Kripke, f, known: dict) -> tuple[DataFrame, Kripke]:
    if isinstance(f, str) or f == TRUE:
        return k.sat(f), k
    op, *args = f
    inner = []
    for x in args:
        k, y = _named(k, x, known)
        inner.append(y)
    if op in ("A", "E"):
        return checkpointed((every_way if op == "A" else some_way)(k, inner[0])), k
    return Kripke(k.states, k.transitions, k.labels).sat((op, *inner)), k
