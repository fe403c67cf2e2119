"""Discrete networks as tables: learning, transformation, marginals, weighted state graph.

A network has ``model_id`` in every table, so that many models are one job:
vertices (model_id, vertex, signal, idx, vals), edges (model_id, src, dst), and
cpt (model_id, vertex, parents, parent_vals, outcome, p), where parents and parent_vals are arrays in the same order.
Learning is one aggregation of the samples; what follows works on tables as small as the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import index_of, metric, signal_of
from ..sources.tables import checkpointed

START, TERMINAL = "start", "terminal"


def observations(found: DataFrame, model: Column, cut: float, length: int) -> DataFrame:
    """Rows (model_id, vertex, parents, parent_vals, outcome), one for each vertex of each sample.

    Signals: E (the event type) and V (hi from ``cut`` on, else lo), a vertex for each place. Edges go from each vertex to the next of its
    signal, and from each E to the next V.
    """
    e = lambda k: F.col("events")[k]["event_type"]
    v = lambda k: F.when(F.col("events")[k]["value"] >= cut, "hi").otherwise("lo")
    none = F.array().cast("array<string>")
    rows = []
    for k in range(length):
        rows.append((f"E_{k}", [f"E_{k - 1}"] if k else [], F.array(e(k - 1)) if k else none, e(k)))
        rows.append((f"V_{k}", [f"V_{k - 1}", f"E_{k - 1}"] if k else [], F.array(v(k - 1), e(k - 1)) if k else none, v(k)))
    structs = [F.struct(F.lit(n).alias("vertex"), F.array(*map(F.lit, pa)).cast("array<string>").alias("parents"), pv.alias("parent_vals"), o.alias("outcome")) for n, pa, pv, o in rows]
    return found.select(model.alias("model_id"), F.explode(F.array(*structs)).alias("x")).select("model_id", "x.*")


def counted(obs: DataFrame) -> DataFrame:
    return obs.groupBy("model_id", "vertex", "parents", "parent_vals", "outcome").agg(F.count("*").alias("n"))


def values(counts: DataFrame) -> DataFrame:
    """Rows (model_id, signal, vals): the sorted values of each signal."""
    return counts.groupBy("model_id", signal_of(F.col("vertex")).alias("signal")).agg(F.array_sort(F.collect_set("outcome")).alias("vals"))


def vertices(counts: DataFrame) -> DataFrame:
    v = counts.select("model_id", "vertex", "parents").distinct().withColumn("signal", signal_of(F.col("vertex")))
    return v.join(values(counts), ["model_id", "signal"]).select("model_id", "vertex", "signal", index_of(F.col("vertex")).alias("idx"), "parents", "vals")


def edges(v: DataFrame) -> DataFrame:
    return v.select("model_id", F.explode("parents").alias("src"), F.col("vertex").alias("dst"))


def learned(counts: DataFrame) -> DataFrame:
    """The full CPT: all parent combinations and outcomes. Unseen outcomes get 0, rows without any count are uniform."""
    v = vertices(counts)
    by_signal = values(counts).select("model_id", F.col("signal").alias("s"), F.col("vals").alias("pv"))
    of_parents = (
        v.select("model_id", "vertex", F.posexplode("parents").alias("i", "pa")).withColumn("s", signal_of(F.col("pa"))).join(by_signal, ["model_id", "s"])
        .groupBy("model_id", "vertex").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "pv"))), lambda x: x["pv"]).alias("choices"))
    )
    # All combinations, the first parent slowest, by unfolding one parent after the other.
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda x: F.transform(c, lambda y: F.concat(x, F.array(y)))))
    empty = F.array(F.array().cast("array<string>"))
    grid = v.join(of_parents, ["model_id", "vertex"], "left").withColumn("choices", F.coalesce("choices", F.array().cast("array<array<string>>")))
    grid = grid.select("model_id", "vertex", "parents", "vals", F.explode(F.aggregate("choices", empty, grow)).alias("parent_vals")).select("model_id", "vertex", "parents", "parent_vals", F.posexplode("vals").alias("outcome_idx", "outcome"))
    n = grid.join(counts.select("model_id", "vertex", "parent_vals", "outcome", "n"), ["model_id", "vertex", "parent_vals", "outcome"], "left")
    row = Window.partitionBy("model_id", "vertex", "parent_vals")
    total = F.sum("n").over(row)
    p = F.when(total.isNull(), 1 / F.count("*").over(row)).otherwise(F.coalesce(F.col("n"), F.lit(0)) / total)
    return n.select("model_id", "vertex", "parents", "parent_vals", "outcome", "outcome_idx", p.alias("p"))


def force_initial(cpt: DataFrame, state: str) -> DataFrame:
    """Roots of signals that have ``state`` are certain to start in it."""
    root = F.size("parents") == 0
    has = F.max((F.col("outcome") == state).cast("int")).over(Window.partitionBy("model_id", "vertex", "parent_vals")) == 1
    return cpt.withColumn("p", F.when(root & has, (F.col("outcome") == state).cast("double")).otherwise(F.col("p")))


def without_initial(cpt: DataFrame, state: str) -> DataFrame:
    """Roots never start in ``state``: its share goes to the others in proportion."""
    row = Window.partitionBy("model_id", "vertex", "parent_vals")
    left = F.when(F.col("outcome") == state, 0.0).otherwise(F.col("p"))
    total = F.sum(left).over(row)
    return cpt.withColumn("p", F.when((F.size("parents") == 0) & (total > 0), left / total).otherwise(F.col("p")))


def state_change(cpt: DataFrame, change: float) -> DataFrame:
    """Sets the chance that a vertex differs from its predecessor (its first parent) to ``change``."""
    row = Window.partitionBy("model_id", "vertex", "parent_vals")
    same = F.coalesce(F.col("outcome") == F.get("parent_vals", F.lit(0)), F.lit(False))
    rest = F.sum(F.when(same, 0.0).otherwise(F.col("p"))).over(row)
    others = F.count(F.when(~same, 1)).over(row)
    spread = F.when(rest > 0, F.col("p") * change / rest).otherwise(change / others)
    return cpt.withColumn("p", F.when(F.size("parents") == 0, F.col("p")).when(same, 1 - change).otherwise(spread))


def without_edges(cpt: DataFrame, gone: DataFrame) -> DataFrame:
    """Drops parents (``gone``: model_id, src, dst): rows that differ in them only are averaged, unweighted, and normalised."""
    lost = gone.groupBy("model_id", F.col("dst").alias("vertex")).agg(F.collect_set("src").alias("lost"))
    t = cpt.join(lost, ["model_id", "vertex"], "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    keep = F.filter(F.arrays_zip("parents", "parent_vals"), lambda x: ~F.array_contains(F.col("lost"), x["parents"]))
    t = t.withColumn("keep", keep).withColumn("parents", F.col("keep.parents")).withColumn("parent_vals", F.col("keep.parent_vals"))
    t = t.groupBy("model_id", "vertex", "parents", "parent_vals", "outcome", "outcome_idx").agg(F.avg("p").alias("p"))
    return t.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("model_id", "vertex", "parent_vals")))


def chosen_edges(e: DataFrame, number: int | None = None, share: float | None = None) -> DataFrame:
    """A ``number`` of each model's edges (model_id, src, dst), or a ``share`` of them (rounded half to even), in the order of a digest of their names. All, if
    there are fewer."""
    each = Window.partitionBy("model_id")
    order = each.orderBy(F.md5(F.concat_ws("|", "model_id", "src", "dst")), "src", "dst")
    most = F.lit(number) if share is None else F.bround(F.count("*").over(each) * F.lit(share))
    return e.withColumn("place", F.row_number().over(order)).withColumn("most", most).where("place <= most").select("model_id", "src", "dst")


def reduced(v: DataFrame, gone: DataFrame) -> DataFrame:
    """Vertices (with parents) without the edges ``gone``."""
    lost = gone.groupBy("model_id", F.col("dst").alias("vertex")).agg(F.collect_set("src").alias("lost"))
    t = v.join(lost, ["model_id", "vertex"], "left")
    return t.withColumn("parents", F.when(F.col("lost").isNull(), F.col("parents")).otherwise(F.array_except("parents", F.coalesce("lost", F.array().cast("array<string>"))))).drop("lost")


def cleared(cpt: DataFrame) -> DataFrame:
    """The same rows with all probabilities 0."""
    return cpt.withColumn("p", F.lit(0.0))


def with_edges(e: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (model_id, src, dst) and ``new`` ones. An edge that is there twice is an error when the rows are read."""
    n = e.unionByName(new).groupBy("model_id", "src", "dst").agg(F.count("*").alias("n"))
    fail = F.raise_error(F.concat(F.lit("the edge is there already: "), "model_id", F.lit(" "), "src", F.lit(" -> "), "dst"))
    return n.select("model_id", "src", F.when(F.col("n") > 1, fail).otherwise(F.col("dst")).alias("dst"))


def with_gaps(e: DataFrame) -> DataFrame:
    """Edges with a vertex dL_v for each vertex v that has parents: from v and from each of its parents."""
    gap = F.concat(F.lit("dL_"), "dst")
    return e.select("model_id", "src", "dst").union(e.select("model_id", "src", gap)).union(e.select("model_id", F.col("dst").alias("src"), gap).distinct())


def without_gaps(e: DataFrame) -> DataFrame:
    """Edges between vertices that are no gaps; vertices without any other edge vanish with theirs."""
    return e.where(~F.col("src").startswith("dL_") & ~F.col("dst").startswith("dL_"))


def reachable_states(e: DataFrame, v: DataFrame, seeds: DataFrame, removed: DataFrame) -> DataFrame:
    """Vertices (model_id, vertex) that can be reached from ``seeds``, not through vertices all of whose values are among the ``removed`` (model_id,
    vertex, outcome)."""
    from .graphs import reachable

    left = v.select("model_id", "vertex", F.explode("vals").alias("outcome")).join(removed, ["model_id", "vertex", "outcome"], "left_anti").select("model_id", "vertex").distinct()
    open_ = e.join(left.withColumnRenamed("vertex", "dst"), ["model_id", "dst"], "left_semi")
    node = lambda c: F.concat_ws("/", "model_id", c)
    found = reachable(open_.select(node("src").alias("src"), node("dst").alias("dst")), seeds.select(node("vertex").alias("node")))
    at = F.split("node", "/", 2)
    return found.select(at[0].alias("model_id"), at[1].alias("vertex"))


def neighbours(e: DataFrame) -> DataFrame:
    """Rows (model_id, vertex, parents, children) of edges, each sorted."""
    up = e.groupBy("model_id", F.col("dst").alias("vertex")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    down = e.groupBy("model_id", F.col("src").alias("vertex")).agg(F.array_sort(F.collect_set("dst")).alias("children"))
    none = F.array().cast("array<string>")
    return up.join(down, ["model_id", "vertex"], "full").select("model_id", "vertex", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def naming_check(v: DataFrame) -> DataFrame:
    """Rows (model_id, consistent): all names are signal_index and the indices of a signal are 0 to n - 1."""
    s = v.withColumn("named", F.col("vertex").rlike(r"^.+_[0-9]+$") & ~F.col("vertex").contains(","))
    per = s.groupBy("model_id", "signal").agg(F.every("named").alias("named"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.count("*").alias("n"), F.countDistinct("idx").alias("d"))
    good = F.col("named") & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n") == F.col("d"))
    return per.groupBy("model_id").agg(F.every(good).alias("consistent"))


def structural_boundary(e: DataFrame, v: DataFrame) -> DataFrame:
    """Edges from ``start`` to vertices (model_id, vertex) without parents, and to ``terminal`` from those without children: for names without indices."""
    roots = v.join(e.select("model_id", F.col("dst").alias("vertex")), ["model_id", "vertex"], "left_anti")
    leaves = v.join(e.select("model_id", F.col("src").alias("vertex")), ["model_id", "vertex"], "left_anti")
    return roots.select("model_id", F.lit(START).alias("src"), F.col("vertex").alias("dst")).union(leaves.select("model_id", "vertex", F.lit(TERMINAL)))


def boundary_edges(v: DataFrame) -> DataFrame:
    """Edges from ``start`` to the first vertex of each signal, and from the last one to ``terminal``."""
    last = F.max("idx").over(Window.partitionBy("model_id", "signal"))
    v = v.withColumn("last", last)
    return v.where("idx = 0").select("model_id", F.lit(START).alias("src"), F.col("vertex").alias("dst")).union(v.where("idx = last AND last > 0").select("model_id", "vertex", F.lit(TERMINAL)))


def cross_edges(e: DataFrame) -> DataFrame:
    inner = ~F.col("src").startswith("dL_") & ~F.col("dst").startswith("dL_")
    return e.where(inner & (signal_of(F.col("src")) != signal_of(F.col("dst"))))


def depths(e: DataFrame, v: DataFrame, levels: int) -> DataFrame:
    """Rows (model_id, vertex, depth): the longest way from a root. ``levels`` bounds it; a cycle is an error."""
    v, e = checkpointed(v.select("model_id", "vertex")), checkpointed(e)
    depth = v.select("model_id", "vertex", F.lit(0).alias("depth"))
    for _ in range(levels):
        further = e.join(depth.withColumnRenamed("vertex", "src"), ["model_id", "src"]).groupBy("model_id", F.col("dst").alias("vertex")).agg((F.max("depth") + 1).alias("d"))
        depth = checkpointed(depth.join(further, ["model_id", "vertex"], "left").select("model_id", "vertex", F.coalesce("d", F.lit(0)).alias("depth")))
    top = F.max("depth").over(Window.partitionBy("model_id"))
    return depth.withColumn("depth", F.when(top < levels, F.col("depth")).otherwise(F.raise_error(F.lit("the graph has a cycle or more levels"))))


def ordered(e: DataFrame, v: DataFrame, levels: int, only: DataFrame | None = None) -> DataFrame:
    """Rows (model_id, vertex, depth, place): vertices in topological order, by depth, then by name. ``only`` (model_id, vertex): of these, where just the edges
    between two of them count, so a way that leaves them orders nothing."""
    if only is not None:
        only = only.select("model_id", "vertex").distinct()
        v = v.join(only, ["model_id", "vertex"], "left_semi")
        e = e.join(only.withColumnRenamed("vertex", "src"), ["model_id", "src"], "left_semi").join(only.withColumnRenamed("vertex", "dst"), ["model_id", "dst"], "left_semi")
        e = e.select("model_id", "src", "dst")
    order = Window.partitionBy("model_id").orderBy("depth", "vertex")
    return depths(e, v, levels).select("model_id", "vertex", "depth", (F.row_number().over(order) - 1).alias("place"))


def marginals(cpt: DataFrame, levels: int) -> DataFrame:
    """Rows (model_id, vertex, outcome, p), taking the parents of a vertex as independent."""
    row = ["model_id", "vertex", "parent_vals", "outcome"]
    cpt = checkpointed(cpt)
    m = cpt.where(F.size("parents") == 0).select("model_id", "vertex", "outcome", "p")
    inner = cpt.where(F.size("parents") > 0).withColumn("x", F.explode(F.arrays_zip("parents", "parent_vals")))
    inner = inner.select(*row, "p", F.size("parents").alias("n"), F.col("x.parents").alias("pa"), F.col("x.parent_vals").alias("pv"))
    for _ in range(levels - 1):
        of = m.select("model_id", F.col("vertex").alias("pa"), F.col("outcome").alias("pv"), F.col("p").alias("q"))
        whole = inner.join(of, ["model_id", "pa", "pv"]).groupBy(*row, "p", "n").agg(F.product("q").alias("q"), F.count("*").alias("k")).where("k = n")
        new = whole.groupBy("model_id", "vertex", "outcome").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        new = new.join(m.select("model_id", "vertex").distinct(), ["model_id", "vertex"], "left_anti")
        m = checkpointed(m.union(new))
    return m


def edge_weights(cpt: DataFrame, m: DataFrame) -> DataFrame:
    """Rows (model_id, src, src_val, dst, dst_val, p, w): chance of a value given one parent's, the others weighted by their marginals."""
    inner = cpt.where(F.size("parents") > 0).withColumn("x", F.arrays_zip("parents", "parent_vals"))
    given = inner.select("model_id", F.col("vertex").alias("dst"), F.col("outcome").alias("dst_val"), "p", F.posexplode("x").alias("i", "of"), "x")
    given = given.select("model_id", "dst", "dst_val", "p", F.col("of.parents").alias("src"), F.col("of.parent_vals").alias("src_val"), F.explode_outer(F.filter("x", lambda y, j: j != F.col("i"))).alias("o"), F.col("x.parent_vals").alias("row"))
    of = m.select("model_id", F.col("vertex").alias("opa"), F.col("outcome").alias("opv"), F.col("p").alias("q"))
    given = given.withColumn("opa", F.col("o.parents")).withColumn("opv", F.col("o.parent_vals")).join(of, ["model_id", "opa", "opv"], "left")
    each = given.groupBy("model_id", "src", "src_val", "dst", "dst_val", "row", "p").agg(F.product(F.coalesce("q", F.lit(1.0))).alias("q"))
    p = each.groupBy("model_id", "src", "src_val", "dst", "dst_val").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return p.withColumn("w", metric(F.col("p")))


def path_count(v: DataFrame, levels: int) -> DataFrame:
    """Rows (model_id, n): state paths from start to terminal."""
    size = v.select("model_id", "vertex", F.size("vals").cast("long").alias("k"))
    v = checkpointed(v)
    whole = checkpointed(edges(v).union(boundary_edges(v)))
    n = v.select("model_id", F.lit(TERMINAL).alias("vertex"), F.lit(1).cast("long").alias("n")).distinct()
    size = size.union(n.select("model_id", F.lit(START).alias("vertex"), F.lit(1).cast("long").alias("k")))
    for _ in range(levels + 1):
        up = whole.join(n.withColumnRenamed("vertex", "dst"), ["model_id", "dst"]).groupBy("model_id", F.col("src").alias("vertex")).agg(F.sum("n").alias("s"))
        n = checkpointed(up.join(size, ["model_id", "vertex"]).select("model_id", "vertex", (F.col("k") * F.col("s")).alias("n")).union(n.where(F.col("vertex") == TERMINAL)))
    return n.where(F.col("vertex") == START).select("model_id", "n")
