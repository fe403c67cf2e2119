"""Registered queries of joins over time, learned Gaussians, exact inference, best paths and what streams keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as c
from .operators import cliques as cl
from .operators import gaussian as ga
from .operators import network as nw
from .operators import paths as pt
from .operators import temporal as tm
from .sources.tables import checkpointed, read, work_path
from .streaming import invariants as si
from .streaming import windows

query = c.query

# ---- joins over time

_TYPES = "ty AS (SELECT DISTINCT event_type AS signal FROM events WHERE event_type IS NOT NULL)"


def _foreign(events):
    """Every event once for each signal (event type) but its own; the list of event types is one row."""
    types = events.agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return events.join(F.broadcast(types), F.lit(True)).select("event_id", "user_id", "ts", "event_type", F.explode("types").alias("signal")).where("signal <> event_type")


@query(
    "asof_signals",
    f"WITH {_TYPES}, l AS (SELECT event_id, user_id, ts, signal FROM events, ty WHERE signal <> event_type), r AS (SELECT user_id, event_type AS signal, ts, arg_max(value, event_id) AS value FROM events GROUP BY ALL)"
    " SELECT l.event_id, l.signal, r.value, ((epoch_us(l.ts) - epoch_us(r.ts)) / 1e6)::DOUBLE AS age FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.signal = r.signal AND l.ts > r.ts",
)
def _(spark, sf_dir):
    """What every other signal of the user last was before each event, and how long ago."""
    e = read(spark, sf_dir, "events")
    found = tm.as_of(_foreign(e), e.withColumnRenamed("event_type", "signal"), ["user_id", "signal"], "ts", ["value"], ["event_id"])
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return found.select("event_id", "signal", F.col("found.value").alias("value"), ((micros("ts") - micros("found.ts")) / 1e6).alias("age"))


@query("asof_last_at", "WITH r AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT l.event_id, r.value FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(spark, sf_dir):
    """The value of the user's last view up to and at each event's time."""
    e = read(spark, sf_dir, "events")
    found = tm.as_of(e, e.where("event_type = 'view'"), ["user_id"], "ts", ["value"], ["event_id"], inclusive=True)
    return found.select("event_id", F.col("found.value").alias("value"))


@query("close_pairs", "SELECT a.event_id AS error_id, b.event_id AS other_id, b.event_type FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'error'")
def _(spark, sf_dir):
    """What a user did from six hours before to two hours after each of their errors."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = tm.close_pairs(e.where("event_type = 'error'"), e, ["user_id"], "ts", 6 * 3600, 2 * 3600)
    return pairs.where("l.event_id <> r.event_id").select(F.col("l.event_id").alias("error_id"), F.col("r.event_id").alias("other_id"), F.col("r.event_type").alias("event_type"))


# ---- linear Gaussian vertices

_GAPS = f"{c.SEQ}, g AS (SELECT a.event_id, a.event_type, a.value, hour(a.ts)::DOUBLE AS hour, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.pos = a.pos + 1)"
_FIT = "f AS (SELECT event_type, count(*) AS n, regr_intercept(gap, value) AS base, regr_slope(gap, value) AS slope, greatest(var_pop(gap) - regr_slope(gap, value) * covar_pop(gap, value), 0) AS variance FROM g GROUP BY event_type)"


def _gaps(spark, sf_dir):
    """The time to a user's next event, with what its mean may depend on."""
    p = c.placed(spark, sf_dir)
    nxt = p.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("ts").alias("later"))
    micros = lambda n: F.unix_micros(F.col(n).cast("timestamp"))
    return p.join(nxt, ["user_id", "pos"]).select("event_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"), ((micros("later") - micros("ts")) / 1e6).alias("gap"))


@query("gaussian_fit", f"WITH {_GAPS}, {_FIT} SELECT event_type, n, round(base, 3) AS mean_base, round(slope, 3) AS slope, round(variance / 1e6, 3) AS variance FROM f")
def _(spark, sf_dir):
    """The gap after an event as a linear Gaussian vertex: one for each event type, its mean linear in the event's value."""
    f = ga.fit(_gaps(spark, sf_dir), ["event_type"], "gap", ["value"])
    return f.select("event_type", "n", F.round("mean_base", 3).alias("mean_base"), F.round(F.col("mean_scal")[0], 3).alias("slope"), F.round(F.col("variance") / 1e6, 3).alias("variance"))


@query(
    "gaussian_fit_two",
    f"WITH {_GAPS}, s AS (SELECT event_type, count(*) AS n, avg(gap) AS my, avg(value) AS m1, avg(hour) AS m2, var_pop(gap) AS yy, covar_pop(gap, value) AS y1, covar_pop(gap, hour) AS y2, var_pop(value) AS s11, var_pop(hour) AS s22, covar_pop(value, hour) AS s12 FROM g GROUP BY event_type),"
    " b AS (SELECT *, (s22 * y1 - s12 * y2) / (s11 * s22 - s12 * s12) AS b1, (s11 * y2 - s12 * y1) / (s11 * s22 - s12 * s12) AS b2 FROM s)"
    " SELECT event_type, n, round(my - b1 * m1 - b2 * m2, 3) AS mean_base, round(b1, 3) AS of_value, round(b2, 3) AS of_hour, round((yy - b1 * y1 - b2 * y2) / 1e6, 3) AS variance FROM b",
)
def _(spark, sf_dir):
    """The same with two continuous parents, the value and the hour."""
    f = ga.fit(_gaps(spark, sf_dir), ["event_type"], "gap", ["value", "hour"])
    return f.select("event_type", "n", F.round("mean_base", 3).alias("mean_base"), F.round(F.col("mean_scal")[0], 3).alias("of_value"), F.round(F.col("mean_scal")[1], 3).alias("of_hour"), F.round(F.col("variance") / 1e6, 3).alias("variance"))


_HASHED = "('0x' || substr(md5(concat_ws('|', 'fit', event_id::VARCHAR, '{}')), 1, 8))::BIGINT / 4294967296.0"


@query("gaussian_draws", f"WITH {_GAPS}, {_FIT} SELECT event_id, round(base + slope * value + sqrt(variance) * sqrt(-2 * ln(1 - {_HASHED.format('u')})) * cos(2 * pi() * {_HASHED.format('v')}), 2) AS draw FROM g JOIN f USING (event_type)")
def _(spark, sf_dir):
    """A draw of the learned vertex for each event."""
    g = checkpointed(_gaps(spark, sf_dir))
    out = ga.draws(g, checkpointed(ga.fit(g, ["event_type"], "gap", ["value"])), ["event_type"], ["value"], [F.lit("fit"), F.col("event_id").cast("string")])
    return out.select("event_id", F.round("draw", 2).alias("draw"))


@query("gaussian_cleared", f"WITH {_GAPS}, {_FIT} SELECT event_type, n, 0.0::DOUBLE AS mean_base, 0.0::DOUBLE AS slope, 0.1::DOUBLE AS variance FROM f")
def _(spark, sf_dir):
    """The vertex with its parameters cleared."""
    f = ga.cleared(ga.fit(_gaps(spark, sf_dir), ["event_type"], "gap", ["value"]))
    return f.select("event_type", "n", "mean_base", F.col("mean_scal")[0].alias("slope"), "variance")


# ---- the best paths of each network

K = 10


def _k_best(spark, sf_dir, k, by_length=False):
    t, v = c._learned(spark, sf_dir)
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    return pt.k_best(nw.edge_weights(t, nw.marginals(t, c.LENGTH)), nw.boundary_edges(v), states, c.LENGTH - 1, k, by_length)


_WALKED = f"all_paths AS (SELECT model_id, n, array_to_string(tokens, ',') AS tokens, w / n AS metric FROM walk WHERE k = {c.LENGTH - 1})"


@query("paths_k_best", f"WITH RECURSIVE {c.PATHS}, {_WALKED} SELECT model_id, (row_number() OVER (PARTITION BY model_id ORDER BY round(metric, 12), tokens))::INT AS place, tokens, round(metric, 9) AS metric FROM all_paths QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY round(metric, 12), tokens) <= {K}")
def _(spark, sf_dir):
    """The ten paths of least mean weight in each network."""
    tokens = F.array_join(F.transform("nodes", lambda x: F.concat(nw.signal_of(x["v"]), F.lit(":"), x["val"])), ",").alias("tokens")
    return _k_best(spark, sf_dir, K).select("model_id", "place", tokens, F.round("metric", 9).alias("metric"))


@query("best_path_nodes", f"WITH RECURSIVE {c.PATHS}, b AS (SELECT model_id, n, arg_min(tokens, round(w / n, 12)) AS tokens, round(min(w / n), 9) AS metric FROM walk WHERE k = {c.LENGTH - 1} GROUP BY ALL) SELECT model_id, n AS n_edges, (i - 1)::INT AS place, tokens[i] AS token, metric FROM b, unnest(range(1, n + 2)) u(i)")
def _(spark, sf_dir):
    """The states of each network's best path, by its number of edges."""
    best = _k_best(spark, sf_dir, 1, by_length=True)
    rows = best.select("model_id", "n_edges", F.round("metric", 9).alias("metric"), F.posexplode("nodes").alias("place", "x"))
    return rows.select("model_id", "n_edges", "place", F.concat(nw.signal_of(F.col("x.v")), F.lit(":"), F.col("x.val")).alias("token"), "metric")


# ---- exact inference

_JOINT = ["j0 AS MATERIALIZED (SELECT e.model_id, 0 AS k, e.outcome AS e, v.outcome AS v, e.p * v.p AS p FROM cpt e JOIN cpt v ON v.model_id = e.model_id AND e.vertex = 'E_0' AND v.vertex = 'V_0')"]
for _k in range(1, c.LENGTH):
    _JOINT.append(f"j{_k} AS MATERIALIZED (SELECT j.model_id, {_k} AS k, e.outcome AS e, v.outcome AS v, sum(j.p * e.p * v.p) AS p FROM j{_k - 1} j JOIN cpt e ON e.model_id = j.model_id AND e.vertex = 'E_{_k}' AND e.pv[1] = j.e JOIN cpt v ON v.model_id = j.model_id AND v.vertex = 'V_{_k}' AND v.pv[1] = j.v AND v.pv[2] = j.e GROUP BY ALL)")
_EXACT = ", ".join(_JOINT) + ", joint AS (" + " UNION ALL ".join(f"SELECT * FROM j{k}" for k in range(c.LENGTH)) + "), exact AS MATERIALIZED (SELECT model_id, 'E' AS signal, k, e AS outcome, sum(p) AS p FROM joint GROUP BY ALL UNION ALL SELECT model_id, 'V', k, v, sum(p) FROM joint GROUP BY ALL)"


@query("marginals_exact", f"WITH {c.LEARN}, {_EXACT} SELECT model_id, signal || '_' || k AS vertex, outcome, round(p, 9) AS p FROM exact")
def _(spark, sf_dir):
    """Chances of all values of all vertices, whatever their parents have in common."""
    return cl.exact_marginals(*c._learned(spark, sf_dir)).select("model_id", "vertex", "outcome", F.round("p", 9).alias("p"))


@query(
    "marginals_given",
    f"WITH {c.LEARN}, j AS (SELECT a.model_id, a.outcome AS e0, b.outcome AS v0, c.outcome AS e1, d.outcome AS v1, a.p * b.p * c.p * d.p AS p FROM cpt a JOIN cpt b ON b.model_id = a.model_id AND a.vertex = 'E_0' AND b.vertex = 'V_0' JOIN cpt c ON c.model_id = a.model_id AND c.vertex = 'E_1' AND c.pv[1] = a.outcome JOIN cpt d ON d.model_id = a.model_id AND d.vertex = 'V_1' AND d.pv[1] = b.outcome AND d.pv[2] = a.outcome),"
    " x AS (SELECT j.model_id, e0, v0, e1, sum(j.p * v.p) AS p FROM j JOIN cpt v ON v.model_id = j.model_id AND v.vertex = 'V_2' AND v.pv[1] = j.v1 AND v.pv[2] = j.e1 WHERE v.outcome = 'hi' GROUP BY ALL),"
    " u AS (SELECT model_id, 'E_0' AS vertex, e0 AS outcome, sum(p) AS p FROM x GROUP BY ALL UNION ALL SELECT model_id, 'V_0', v0, sum(p) FROM x GROUP BY ALL UNION ALL SELECT model_id, 'E_1', e1, sum(p) FROM x GROUP BY ALL)"
    " SELECT model_id, vertex, outcome, round(p / sum(p) OVER (PARTITION BY model_id, vertex), 9) AS p FROM u",
)
def _(spark, sf_dir):
    """Chances of what came before, given that the third value is high."""
    t, v = c._learned(spark, sf_dir)
    seen = v.select("model_id").distinct().select("model_id", F.lit("V_2").alias("vertex"), F.lit("hi").alias("outcome"))
    return cl.exact_marginals(t, v, seen).where(F.col("vertex").isin("E_0", "V_0", "E_1")).select("model_id", "vertex", "outcome", F.round("p", 9).alias("p"))


@query("marginals_difference", f"WITH {c.LEARN}, {c.MARGINALS}, {_EXACT} SELECT x.model_id, x.signal || '_' || x.k AS vertex, round(max(abs(x.p - m.p)), 9) AS difference FROM exact x JOIN marg m ON m.model_id = x.model_id AND m.signal = x.signal AND m.k = x.k AND m.outcome = x.outcome GROUP BY ALL")
def _(spark, sf_dir):
    """How far the marginals of independent parents are from the exact ones."""
    t, v = c._learned(spark, sf_dir)
    plain = nw.marginals(t, c.LENGTH).withColumnRenamed("p", "q")
    both = cl.exact_marginals(t, v).join(plain, ["model_id", "vertex", "outcome"])
    return both.groupBy("model_id", "vertex").agg(F.round(F.max(F.abs(F.col("p") - F.col("q"))), 9).alias("difference"))


# ---- streams


@query("stream_invariant_counts", f"WITH {c.PAIRS} SELECT * FROM pairs")
def _(spark, sf_dir):
    """The invariants' counts kept by a stream over the events. All files that are there are one batch, so none of their events is late."""
    stream = windows.event_stream(spark, sf_dir)
    hi = F.when(F.col("value") >= c.CUT, "hi").otherwise("lo")
    tokens = stream.withColumn("event_type", F.concat(F.col("event_type"), F.lit(":"), hi))
    return si.pair_counts(checkpointed(si.run_to_end(si.segment_summaries(tokens, late="1 day"), work_path(spark))))
