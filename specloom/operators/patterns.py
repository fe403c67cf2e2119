"""Sequence patterns: merging token sequences into patterns of letters, groups and options, and turning patterns into logic.

A pattern is an array of symbols (tokens, kind, xable): a letter has one token, a group alternatives, an option may be left out. Merging
aligns a sequence with the pattern by edit distance, where a token is free if the symbol has it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER, GROUP, OPTION = "letter", "group", "option"
SYMBOLS = "array<struct<tokens:array<string>,kind:string,xable:boolean>>"


def letters(tokens: Iterable[str], xable: Iterable[bool]) -> list[dict]:
    return [{"tokens": [t], "kind": LETTER, "xable": bool(x)} for t, x in zip(tokens, xable, strict=True)]


def alignment(pattern: list[dict], tokens: list[str]) -> list[str]:
    """Steps from pattern to tokens: insert, delete, substitute, match. Read from the end, the first that fits in this order wins."""
    cost = [list(range(len(tokens) + 1))]
    for i, s in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(tokens, 1):
            row.append(min(cost[-1][j] + 1, row[-1] + 1, cost[-1][j - 1] + (t not in s["tokens"])))
        cost.append(row)
    i, j, steps = len(pattern), len(tokens), []
    while i or j:
        here = cost[i][j]
        if j and cost[i][j - 1] + 1 == here:
            steps.append("insert")
            j -= 1
        elif i and cost[i - 1][j] + 1 == here:
            steps.append("delete")
            i -= 1
        else:
            steps.append("substitute" if cost[i - 1][j - 1] + 1 == here else "match")
            i, j = i - 1, j - 1
    return steps[::-1]


def merged(pattern: list[dict], tokens: list[str], xable: list[bool]) -> list[dict]:
    """The pattern that also covers ``tokens``: what is left out or added becomes an option, what differs a group.

    A symbol stays xable (may be the very next) only if it is in all its sequences; after an added token it takes the new flag, after a
    left-out one it keeps its own.
    """
    out, old, new, before = [], iter(pattern), iter(zip(tokens, xable, strict=True)), "match"
    for step in alignment(pattern, tokens):
        if step == "insert":
            t, x = next(new)
            out.append({"tokens": [t], "kind": OPTION, "xable": x})
        elif step == "delete":
            out.append({**next(old), "kind": OPTION})
        else:
            s, (t, x) = dict(next(old)), next(new)
            if step == "substitute" and t not in s["tokens"]:
                s["tokens"] = [*s["tokens"], t]
                s["kind"] = GROUP if s["kind"] == LETTER else s["kind"]
            if before == "insert":
                s["xable"] = x
            elif before != "delete":
                s["xable"] = s["xable"] and x
            out.append(s)
        before = step
    return out


def acceptance(pattern: list[dict]) -> tuple[bool, int]:
    """The values of ``compared`` and ``by_metric`` of ``metrics``, inside a task."""
    fixed = [i for i, s in enumerate(pattern) if s["kind"] != OPTION]
    part = pattern[fixed[0] : fixed[-1] + 1] if fixed else []
    if len(part) < 2:
        return False, -1
    ratio, strings = sum(s["kind"] == LETTER for s in part) / len(part), 1
    for s in part:
        strings *= len(s["tokens"]) if s["kind"] == GROUP else len(s["tokens"]) + 1 if s["kind"] == OPTION else 1
    half = len(part) // 2
    by_metric = -1 if ratio < 0.5 or strings > 2**half else 0 if ratio > 0.8 or strings < 2 ** (len(part) // 5 + 1) else 1
    return ratio >= 0.5 and strings <= 2.5**half, by_metric


def extended(pattern: list[dict] | None, tokens: list[str], xable: list[bool], compared: bool, by_metric: int) -> tuple[list[dict], bool, int]:
    """A pattern with one more sequence, and what the acceptance rules say then: ``compared`` until the comparison refuses a pattern, ``by_metric`` the first verdict
    of the metrics. A run is over when both have ended it."""
    pattern = letters(tokens, xable) if pattern is None else merged(pattern, tokens, xable)
    now = acceptance(pattern)
    return pattern, compared and now[0], by_metric or now[1]


def merge_runs(sequences: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (key, step, symbols): for each key the pattern after each of its sequences (key, ord, tokens, xable), in order: the first ``most``, or
    else until both acceptance rules have ended the run (the comparison at the first pattern that it refuses, the metrics at the first that they
    take or refuse); that pattern is the last row. The loop depends on its order, so a key is one group.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pattern, out, compared, by_metric = None, [], True, 0
        for i, (tokens, xable) in enumerate(rows.sort_values("ord")[["tokens", "xable"]].itertuples(index=False)):
            pattern, compared, by_metric = extended(pattern, list(tokens), list(xable), compared, by_metric)
            out.append((rows.key.iloc[0], i, pattern))
            if most is None and not compared and by_metric:
                break
        return pd.DataFrame(out, columns=["key", "step", "symbols"])

    first = sequences if most is None else sequences.where(F.col("ord") < most)
    return first.select(F.col("key").cast("string"), "ord", "tokens", "xable").groupBy("key").applyInPandas(run, f"key string, step int, symbols {SYMBOLS}")


def edge_flags(v: DataFrame, share: float = 0.7) -> DataFrame:
    """Rows (model_id, src, dst, xable) for the edges of vertices (model_id, vertex, parents): by the vertex's hash, a ``share`` of the vertices has
    one parent whose edge is xable."""
    code = F.md5(F.concat_ws("|", F.lit("xable"), "model_id", "vertex"))
    number = lambda at: F.conv(F.substring(code, at, 8), 16, 10).cast("long")
    chosen = F.when(number(1) / 4294967296 < share, number(9) % F.size("parents")).otherwise(-1)
    return v.where(F.size("parents") > 0).withColumn("chosen", chosen).select("model_id", F.col("vertex").alias("dst"), "chosen", F.posexplode("parents").alias("i", "src")).select("model_id", "src", "dst", (F.col("i") == F.col("chosen")).alias("xable"))


def trimmed(symbols: Column) -> Column:
    """Without the options before the first and after the last other symbol."""
    fixed = F.filter(F.transform(symbols, lambda s, i: F.when(s["kind"] != OPTION, i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(fixed) > 0, F.slice(symbols, F.element_at(fixed, 1), F.element_at(fixed, -1) - F.element_at(fixed, 1) + 1)).otherwise(F.slice(symbols, 1, 0))


def metrics(patterns: DataFrame) -> DataFrame:
    """Adds length, letters, ratio, strings (how many the pattern matches), and the two acceptance rules. A pattern with fewer than
    two symbols that aren't options has zeros."""
    p = patterns.withColumn("_t", trimmed(F.col("symbols"))).withColumn("_n", F.size("_t"))
    ok = F.col("_n") >= 2
    count = lambda s: F.when(s["kind"] == GROUP, F.size(s["tokens"])).when(s["kind"] == OPTION, F.size(s["tokens"]) + 1).otherwise(1)
    strings = F.aggregate("_t", F.lit(1).cast("long"), lambda a, s: a * count(s))
    n_letters = F.size(F.filter("_t", lambda s: s["kind"] == LETTER))
    p = p.withColumn("length", F.when(ok, F.col("_n")).otherwise(0)).withColumn("letters", F.when(ok, n_letters).otherwise(0)).withColumn("ratio", F.when(ok, n_letters / F.col("_n")).otherwise(0.0)).withColumn("strings", F.when(ok, strings).otherwise(0))
    half = F.floor(F.col("length") / 2)
    compared = (F.col("ratio") >= 0.5) & (F.col("strings") <= F.pow(F.lit(2.5), half))
    low, high = F.pow(F.lit(2), F.floor(F.col("length") / 5) + 1), F.pow(F.lit(2), half)
    by_metric = F.when((F.col("ratio") > 0.8) & (F.col("strings") > high), -1).when(F.col("ratio") < 0.5, -1).when(F.col("strings") > high, -1).when((F.col("ratio") > 0.8) | (F.col("strings") < low), 0).otherwise(1)
    return p.withColumn("compared", compared).withColumn("by_metric", by_metric).drop("_t", "_n")


def as_text(symbols: Column) -> Column:
    """<X> or <F> before each symbol, alternatives by bars, options with a question mark."""
    one = lambda s: F.concat(F.when(s["xable"], "<X>").otherwise("<F>"), F.lit("("), F.array_join(s["tokens"], "|"), F.lit(")"), F.when(s["kind"] == OPTION, "?").otherwise(""))
    t = trimmed(symbols)
    return F.when(F.size(t) > 0, F.array_join(F.transform(t, one), "")).otherwise("<empty spec>")


def _either(s: Column) -> Column:
    """Alternatives as nested disjunctions, from the left."""
    head = F.element_at(s["tokens"], 1)
    return F.aggregate(F.slice(s["tokens"], 2, F.greatest(F.size(s["tokens"]) - 1, F.lit(0))), head, lambda a, t: F.concat(F.lit("("), a, F.lit(" or "), t, F.lit(")")))


def as_ctl(symbols: Column) -> Column:
    """The branching-time formula of a pattern, folded from its last fixed symbol; null with fewer than two of these."""
    fixed = F.filter(F.transform(symbols, lambda s, i: F.when(s["kind"] != OPTION, i + 1)), lambda i: i.isNotNull())
    upto = F.reverse(F.slice(symbols, 1, F.element_at(fixed, -1)))
    step = lambda a, s: F.when(a == "", _either(s)).when(s["kind"] == OPTION, F.concat(F.lit("E("), _either(s), F.lit(" U "), a, F.lit(")"))).otherwise(F.concat(F.lit("("), _either(s), F.lit(" and EX("), a, F.lit("))")))
    return F.when(F.size(fixed) >= 2, F.aggregate(upto, F.lit(""), step))


def _conclusion_after(symbols: list[dict], fixed: list[int]) -> int | None:
    """The place of the premise's last symbol; None if all of the pattern would be premise. ``fixed``: places of symbols that aren't options.

    The first symbol alone is the premise, unless a later symbol shares a token with it: then an observer can't tell where the pattern began, and
    the premise grows by as many fixed symbols as the part behind that later symbol has in common with the pattern's own beginning. Options behind
    it may be left out, so the common part may start at each of them and at the fixed symbol after them; the longest counts.
    """
    shared = [[not set(a["tokens"]).isdisjoint(b["tokens"]) for b in symbols] for a in symbols]
    again = [k for k in range(fixed[0] + 1, fixed[-1] + 1) if shared[0][k]]
    if not again:
        return 0
    behind = {j for k in again for j in range(k + 1, next((i + 1 for i in fixed if i > k), 0))}
    if not behind:  # the pattern's last symbol is the only one
        return 1
    second = next(n for n, i in enumerate(fixed) if i)
    common = max(sum(1 for _ in takewhile(lambda pair: shared[pair[0]][pair[1]], zip(fixed[second:], range(j, fixed[-1] + 1), strict=False))) for j in behind)
    return fixed[second + common] if second + common < len(fixed) - 1 else None


def _any_of(symbol: dict):
    first, *more = symbol["tokens"]
    for t in more:
        first = ("or", first, t)
    return first


def linear_formula(symbols: list[dict]):
    """The linear-time formula of a pattern as nested tuples: always, if the premise's symbols follow each other, the others follow. None if
    there are fewer than two fixed symbols or nothing is left to conclude. What is xable follows in the next step, other symbols some time; options
    before a symbol become an until."""
    fixed = [i for i, s in enumerate(symbols) if s["kind"] != OPTION]
    if len(fixed) < 2:
        return None
    last, end = fixed[-1], _conclusion_after(symbols, fixed)
    if end is None or end >= last:
        return None
    soon = lambda f, now: ("X", f) if now else ("X", ("F", f))
    # From the end: what follows each fixed symbol, with the options before it folded in.
    rest, k = None, last
    while k > end:
        options = k
        while options - 1 > end and symbols[options - 1]["kind"] == OPTION:
            options -= 1
        body = _any_of(symbols[k]) if rest is None else ("and", _any_of(symbols[k]), rest)
        if options == k:
            now = symbols[k]["xable"]
        else:
            loose = [i for i in range(options + 1, k + 1) if not symbols[i]["xable"]]  # options before a symbol that may come later don't hold until it
            start = loose[-1] if loose else options
            now = symbols[options]["xable"] and not loose
            for i in reversed(range(start, k)):
                body = ("U", _any_of(symbols[i]), body)
        rest, k = soon(body, now), options - 1
    *before, tail = [None, *(_any_of(symbols[i]) for i in fixed if i <= end)]
    claim = rest if tail is None else ("imply", tail, rest)
    return ("G", reduce(lambda then, name: ("imply", name, ("X", ("G", then))), before[:0:-1], claim))


def formula_height(f, with_names: bool = True) -> int:
    """Nested operators; without names an operator over names alone counts nothing."""
    if isinstance(f, str):
        return 0
    return max([formula_height(x, with_names) + 1 for x in f[1:] if with_names or not isinstance(x, str)], default=0)


def formula_names(f) -> list[str]:
    return [f] if isinstance(f, str) else [n for x in f[1:] for n in formula_names(x)]


def formula_size(f) -> tuple[int, int, int]:
    """(height, leaves, distinct leaves) of a linear formula. Below a premise every operator counts; without one, operators over names alone don't."""
    names = formula_names(f)
    return formula_height(f, f[1][0] == "imply") - 1, len(names), len(set(names))
