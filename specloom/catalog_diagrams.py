"""Registered queries of decision diagrams over boolean columns of ``events``, and of model texts in a loose dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as c
from .operators import diagrams as dd
from .sources.tables import checkpointed, parsed_models, read

query = c.query

#: Five bits each of the user, the hour, the day of the month and the value.
N = 20
_ON = "d_on AS MATERIALIZED (SELECT DISTINCT event_type AS fn, (((user_id % 32) * 32 + hour(ts)) * 32 + day(ts)) * 32 + floor(value)::BIGINT % 32 AS a FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)"


def _levels(on: str) -> str:
    """SQL of (fn, variable, n_nodes): different subfunctions that depend on their first variable, each as the list of its true assignments."""
    return (
        f"d_k AS (SELECT range::INT AS variable, (1::BIGINT << ({N} - range)) AS size FROM range({N})),"
        f" d_sub AS (SELECT fn, variable, size, list(a % size ORDER BY a) AS s FROM {on}, d_k GROUP BY fn, variable, size, a // size),"
        " d_halves AS (SELECT DISTINCT fn, variable, list_filter(s, lambda x: x < size // 2) AS low, list_transform(list_filter(s, lambda x: x >= size // 2), lambda x: x - size // 2) AS high FROM d_sub)"
        " SELECT fn, variable, count(*) AS n_nodes FROM d_halves WHERE low <> high GROUP BY ALL"
    )


def _rows(spark, sf_dir):
    bits = lambda x: [F.getbit(x.cast("bigint"), F.lit(i)) == 1 for i in range(4, -1, -1)]
    v = [*bits(F.col("user_id")), *bits(F.hour("ts")), *bits(F.dayofmonth("ts")), *bits(F.floor("value"))]
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("fn"), dd.assignment(v).alias("assignment"))


def _sizes(nodes, roots):
    return dd.reached(nodes, roots, N).groupBy("fn", "variable").agg(F.count("*").alias("n_nodes"))


@query("diagram_nodes", f"WITH {_ON}, {_levels('d_on')}")
def _(spark, sf_dir):
    """The size of each event type's reduced diagram, level by level: true where an event with these bits was seen."""
    return _sizes(*dd.built(_rows(spark, sf_dir), N))


@query("diagram_counts", f"WITH {_ON} SELECT fn, count(*) AS n_true FROM d_on GROUP BY fn")
def _(spark, sf_dir):
    """At how many assignments each of them is true, from the diagram alone."""
    return dd.counted(*dd.built(_rows(spark, sf_dir), N), N).select("fn", F.col("n_true").cast("bigint").alias("n_true"))


_PAIRS = (
    "d_fn AS (SELECT DISTINCT fn FROM d_on), d_pair AS (SELECT x.fn AS f, y.fn AS g FROM d_fn x JOIN d_fn y ON x.fn < y.fn),"
    " d_both AS MATERIALIZED (SELECT f, g, a, bool_or(d_on.fn = f) AS x, bool_or(d_on.fn = g) AS y FROM d_pair JOIN d_on ON d_on.fn = f OR d_on.fn = g GROUP BY ALL),"
    " d_out AS MATERIALIZED (SELECT f || ' and ' || g AS fn, a FROM d_both WHERE x AND y UNION ALL SELECT f || ' or ' || g, a FROM d_both UNION ALL SELECT f || ' xor ' || g, a FROM d_both WHERE x <> y)"
)


@query("diagram_applied", f"WITH {_ON}, {_PAIRS}, {_levels('d_out')}")
def _(spark, sf_dir):
    """The sizes of what and, or, xor make of every two event types' diagrams, all in one pass."""
    nodes, roots = dd.built(_rows(spark, sf_dir), N)
    left, right = roots.toDF("f", "a"), roots.toDF("g", "b")
    pairs = left.join(right, F.col("f") < F.col("g")).withColumn("op", F.explode(F.array(*[F.lit(x) for x in ("and", "or", "xor")])))
    return _sizes(*dd.applied(nodes, checkpointed(pairs.select(F.concat_ws(" ", "f", "op", "g").alias("fn"), "op", "a", "b")), N))


@query(
    "diagram_equivalent",
    "WITH d_u AS (SELECT user_id, list_sort(list(DISTINCT (hour(ts) % 8) * 2 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id) SELECT user_id, min(user_id) OVER (PARTITION BY s) AS same_as FROM d_u",
)
def _(spark, sf_dir):
    """Users with the same function of (three bits of the hour, whether it was an error): they share a root."""
    v = [*[F.getbit(F.hour("ts").cast("bigint"), F.lit(i)) == 1 for i in (2, 1, 0)], F.col("event_type") == "error"]
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), dd.assignment(v).alias("assignment"))
    return dd.equal_pairs(dd.built(rows, len(v))[1]).select(F.col("fn").alias("user_id"), "same_as")


# ---- model texts in a loose dialect

_STATE = "CASE user_id % 4 WHEN 0 THEN 'whole' WHEN 3 THEN 'broken' ELSE 'repaired' END"


@query(
    "model_text_loose",
    "WITH m_n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL), m_s AS (SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 4) AS p FROM m_n)"
    f" SELECT user_id, {_STATE} AS state, CASE WHEN user_id % 4 <> 3 THEN 'None .5' END AS vertex, CASE WHEN user_id % 4 <> 3 THEN string_agg(event_type, ',' ORDER BY event_type) END AS vals, CASE WHEN user_id % 4 <> 3 THEN round(sum(p), 4) END AS total FROM m_s GROUP BY user_id",
)
def _(spark, sf_dir):
    """A model text for each user, by the user's remainder strict, with bare points, with None, or cut short; as it is read again. The vertex's name is what is
    loose outside literals."""
    n = read(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    users = n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("x"), F.sum("n").alias("all"))
    share = F.transform("x", lambda x: F.format_string("%.4f", x["n"] / F.col("all")))
    share = F.when(F.col("user_id") % 4 == 1, F.transform(share, lambda p: F.regexp_replace(p, "^0", ""))).otherwise(share)
    kind = F.when(F.col("user_id") % 4 == 2, "None").otherwise('"discrete"')
    vals = F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["event_type"], F.lit('"'))), ", ")
    text = F.concat(F.lit('{"V": ["None .5"], "E": [],\n "Vdata": {"None .5": {"vals": ['), vals, F.lit('], "type": '), kind, F.lit(', "cprob": ['), F.array_join(share, ", "), F.lit("]}}}"))
    whole = users.select(F.col("user_id").alias("model_id"), text.alias("t"))
    found = parsed_models(whole.select("model_id", F.when(F.col("model_id") % 4 == 3, F.expr("substring(t, 1, length(t) - 3)")).otherwise(F.col("t")).alias("text")))
    node = F.element_at(F.map_values("Vdata"), 1)
    probs = F.from_json(node["cprob"], "array<double>")
    return found.select(F.col("model_id").alias("user_id"), "state", F.col("V")[0].alias("vertex"), F.array_join(node["vals"], ",").alias("vals"), F.round(F.aggregate(probs, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))
