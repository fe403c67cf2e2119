"""Plans of several operators: from accepted paths to patterns, and the two specification miners.

Paths are merged with their neighbours path by path, each a group of its own; every pattern on the way is measured and held against a second network in its own
row. Which specifications are kept depends on those accepted before, so that last step takes a model's results in order, without patterns
that no rule could accept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edit, matching, network, patterns
from ..operators.logic import text
from ..sources.tables import checkpointed


def flagged(paths: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds xable to paths with nodes: the flag (model_id, src, dst, xable) of the edge into each node, false for the first."""
    e = paths.select("model_id", "path_id", F.posexplode("nodes").alias("i", "x"), "nodes").withColumn("src", F.when(F.col("i") > 0, F.get("nodes.v", F.col("i") - 1)))
    e = e.select("model_id", "path_id", "i", "src", F.col("x.v").alias("dst")).join(flags, ["model_id", "src", "dst"], "left")
    each = e.groupBy("model_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("xable", F.lit(False)).alias("f")))), lambda x: x["f"]).alias("xable"))
    return paths.join(each, ["model_id", "path_id"])


RUN = f"n int, total double, symbols {patterns.SYMBOLS}, still_compared boolean, verdict int"
STEPS = f"model_id string, path_id int, step int, member int, probability double, {RUN}, last boolean"
_SYMBOLS = pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("kind", pa.string()), ("xable", pa.bool_())]))
_STEP_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), _SYMBOLS, pa.bool_(), pa.int32(), pa.bool_()]


def _merged_on(state: pa.Table, near: pa.Table) -> pa.Table:
    """One path's run, merged with the members of a ring in order until it is over: a row for each merge, the last one of them (or, if there are none, a row without a step) with
    the state to go on from."""
    rows = []
    for s in state.to_pylist():
        n, total, pattern, compared, verdict = (s[c] for c in ("n", "total", "symbols", "still_compared", "verdict"))
        head = (s["model_id"], s["path_id"])
        for r in sorted(near.to_pylist(), key=lambda r: r["member"]):
            pattern, compared, verdict = patterns.extended(pattern, r["tokens"], r["xable"], compared, verdict)
            n, total = n + 1, total + r["metric"]
            rows.append((*head, n - 1, r["member"], 1 - total / n, n, total, pattern, compared, verdict, False))
            if not compared and verdict:
                break
        if rows:
            rows[-1] = (*rows[-1][:-1], True)
        else:
            rows.append((*head, None, None, None, n, total, pattern, compared, verdict, True))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 11, _STEP_KINDS, strict=True)], names=[f.split()[0] for f in ("model_id", "path_id", "step", "member", "probability", "n", "total", "symbols", "still_compared", "verdict", "last")])


def attempts(paths: DataFrame) -> DataFrame:
    """Rows (model_id, path_id, step, member, probability, symbols, length, letters, ratio, strings, compared, by_metric): each path of rows (model_id, path_id,
    tokens, xable, metric) merged with the others by distance, one after the other, until both acceptance rules have ended the run. ``member`` is the
    path merged in this step; the probability is one less the mean metric of the paths merged so far.

    Paths at distance 0, 1, 2 ... are looked for in rounds, for runs that aren't over; most end in the first rounds, so pairs that no run needs are never made.
    """
    paths = checkpointed(paths.select("model_id", F.col("path_id").cast("int").alias("path_id"), "tokens", "xable", "metric"))
    index = checkpointed(edit.indexed(paths))
    longest = paths.agg(F.max(F.size("tokens"))).first()[0] or 0
    none = F.lit(None)
    state = paths.select("model_id", "path_id", F.lit(0).alias("n"), F.lit(0.0).alias("total"), none.cast(patterns.SYMBOLS).alias("symbols"), F.lit(True).alias("still_compared"), F.lit(0).alias("verdict"))
    other = paths.select("model_id", F.col("path_id").alias("member"), "tokens", "xable", "metric")
    found = None
    for d in range(longest + 1):
        near = edit.ring(state, index, d).select("model_id", F.col("a").alias("path_id"), F.col("b").alias("member")).join(other, ["model_id", "member"])
        rows = checkpointed(state.groupBy("model_id", "path_id").cogroup(near.groupBy("model_id", "path_id")).applyInArrow(_merged_on, STEPS))
        steps = rows.where("step IS NOT NULL").select("model_id", "path_id", "step", "member", "probability", "symbols")
        found = steps if found is None else found.union(steps)
        state = rows.where("last AND (still_compared OR verdict = 0)").select("model_id", "path_id", "n", "total", "symbols", "still_compared", "verdict")
        if state.isEmpty():
            break
    return patterns.metrics(found)


def patterns_of_paths(paths: DataFrame) -> DataFrame:
    """The attempts with their patterns as text and as branching-time formulas."""
    return attempts(paths).select("model_id", "path_id", "step", "probability", patterns.as_text(F.col("symbols")).alias("pattern"), patterns.as_ctl(F.col("symbols")).alias("ctl"), "length", "letters", "ratio", "strings", "compared", "by_metric")


def judge(cpt: DataFrame, vertices: DataFrame, levels: int) -> DataFrame:
    """A row (model_id, nodes, weights, n_paths) per network for ``matching``; it is as large as one network."""
    v = checkpointed(vertices)
    e = network.edges(v)
    children = e.groupBy("model_id", F.col("src").alias("vertex")).agg(F.array_sort(F.collect_list("dst")).alias("children"))
    node = F.struct("vertex", "signal", "idx", "vals", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    nodes = v.join(children, ["model_id", "vertex"], "left").groupBy("model_id").agg(F.collect_list(node).alias("nodes"))
    w = network.edge_weights(cpt, network.marginals(cpt, levels))
    weights = w.groupBy("model_id").agg(F.collect_list(F.struct("src", "src_val", "dst", "dst_val", "w")).alias("weights"))
    return nodes.join(weights, "model_id").join(network.path_count(v, levels).withColumnRenamed("n", "n_paths"), "model_id")


def compared(found: DataFrame, judges: DataFrame, parts: int = 8) -> DataFrame:
    """Adds to attempts how many states of the second network satisfy the pattern, and the least mean weight of its matches there (null: none, or
    more matches than the network has paths)."""

    names, kinds = ["model_id", "path_id", "step", "n_states", "n_matches", "least"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]

    def hold(tries: pa.Table, network_: pa.Table) -> pa.Table:
        out = []
        for n in network_.to_pylist() if tries.num_rows else []:
            net = matching.Network(n["nodes"], n["weights"])
            for r in tries.to_pylist():
                states = matching.satisfying(r["symbols"], net)
                matches, least = matching.match_weights(r["symbols"], states, net) if states else (0, None)
                out.append((r["model_id"], r["path_id"], r["step"], len(states), matches, least if matches <= n["n_paths"] else None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    # A network meets the attempts of its model in ``parts`` groups, so that it is read once for many attempts and a model is many tasks.
    tries = found.where("compared").select("model_id", F.col("path_id").cast("int").alias("path_id"), F.col("step").cast("int").alias("step"), "symbols", F.pmod(F.col("path_id").cast("int"), F.lit(parts)).alias("part"))
    each = judges.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = tries.groupBy("model_id", "part").cogroup(each.groupBy("model_id", "part")).applyInArrow(hold, "model_id string, path_id int, step int, n_states long, n_matches long, least double")
    return found.join(held, ["model_id", "path_id", "step"], "left")


SPECS = "model_id string, path_id int, probability double, ltl string, height int, leaves int, names int, n_merged int, loose boolean"


def _kept(found: DataFrame, accept) -> DataFrame:
    """Specifications of attempts, path by path. ``accept(step)``: None to go on, False to end the path, True to accept its pattern and end. A path ends,
    too, when all members of an accepted specification are merged; an accepted one replaces those with all of its members. ``loose``: the
    pattern matches more strings than paths were merged."""

    def fold(t: pa.Table) -> pa.Table:
        paths: dict[int, list[dict]] = {}
        for r in sorted(t.to_pylist(), key=lambda r: (r["path_id"], r["step"])):
            paths.setdefault(r["path_id"], []).append(r)
        specs: list[tuple[set, tuple]] = []
        for path_id, steps in paths.items():
            members: set = set()
            for r in steps:
                members = members | {r["member"]}
                if any(m <= members for m, _ in specs):
                    break
                verdict = accept(r)
                if verdict is None:
                    continue
                if verdict:
                    formula = patterns.linear_formula(r["symbols"])
                    if formula is not None or r["null_too"]:
                        size = patterns.formula_size(formula) if formula is not None else (None, None, None)
                        specs = [s for s in specs if not members <= s[0]]
                        specs.append((members, (r["model_id"], path_id, r["probability"], None if formula is None else text(formula), *size, len(members), r["strings"] > len(members))))
                break
        columns = list(zip(*(s for _, s in specs), strict=True)) or [[]] * 9
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["model_id", "path_id", "probability", "ltl", "height", "leaves", "names", "n_merged", "loose"])

    return found.groupBy("model_id").applyInArrow(fold, SPECS)


def comparison_based(found: DataFrame, judges: DataFrame) -> DataFrame:
    """Specifications of attempts (with a threshold ``theta``) whose pattern a second network satisfies: a path is merged on until some state of that
    network satisfies the formula, and is accepted if the least mean weight of a match there is below 1 - theta."""

    def accept(r: dict) -> bool | None:
        if not r["compared"] or sum(s["kind"] != patterns.OPTION for s in r["symbols"]) < 2:
            return False
        if not r["n_states"]:
            return None
        return r["least"] is not None and r["least"] < 1 - r["theta"]

    t = compared(found, judges).select("model_id", F.col("path_id").cast("int"), F.col("step").cast("int"), "member", "probability", "symbols", "strings", "compared", "theta", "n_states", "least", F.lit(False).alias("null_too"))
    return _kept(t, accept)


def metric_based(found: DataFrame) -> DataFrame:
    """Specifications by the pattern's own metrics: merged on until the metrics take or refuse it. One without a linear formula has null for it."""
    t = found.select("model_id", F.col("path_id").cast("int"), F.col("step").cast("int"), "member", "probability", "symbols", "strings", "by_metric", F.lit(True).alias("null_too"))
    return _kept(t, lambda r: None if r["by_metric"] == 0 else r["by_metric"] > 0)
