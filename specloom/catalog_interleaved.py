"""Registered queries of mining from interleaved logs: what counts as found between origins that have nothing to do with each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as c
from . import catalog_mining as cm
from .operators import interleaved as il
from .operators import network as nw
from .operators import paths as pt
from .operators import traces as tr
from .plans import mining
from .sources.tables import checkpointed, read

query = c.query
#: Numbers of origins in a log; lengths of the origins' samples: 3, 4, 3, 4, 3.
ORIGINS, LONGEST = (2, 3, 4, 5), 4

_IN_LOGS = f"""{c.SEQ}, org AS (SELECT unnest([{", ".join(map(str, ORIGINS))}]) AS n),
logs AS MATERIALIZED (SELECT n, user_id // n AS log, user_id % n AS o, user_id, event_id, ts, pos, event_type, CASE WHEN value >= {c.CUT} THEN 'hi' ELSE 'lo' END AS v FROM seq, org)"""
_NETS = f"""{_IN_LOGS}, vals_ AS MATERIALIZED (SELECT n, log, pos // (3 + o % 2) AS sample, o, (pos % (3 + o % 2))::INT AS idx, v FROM logs),
nb AS (SELECT n, o, lag(o) OVER (PARTITION BY n, log ORDER BY ts, event_id) AS other FROM logs),
bef AS (SELECT n, o, other FROM nb WHERE other IS NOT NULL AND other <> o GROUP BY n, o, other QUALIFY row_number() OVER (PARTITION BY n, o ORDER BY count(*) DESC, other) = 1),
ob AS (SELECT x.n, x.o, 0 AS idx, NULL AS other, [] AS pv, x.v AS outcome FROM vals_ x WHERE idx = 0
  UNION ALL SELECT x.n, x.o, x.idx, b.other, CASE WHEN b.other IS NOT NULL AND x.idx - 1 <= 2 + b.other % 2 THEN [p.v, q.v] ELSE [p.v] END, x.v FROM vals_ x JOIN vals_ p ON p.n = x.n AND p.log = x.log AND p.sample = x.sample AND p.o = x.o AND p.idx = x.idx - 1 JOIN bef b ON b.n = x.n AND b.o = x.o
    LEFT JOIN vals_ q ON q.n = x.n AND q.log = x.log AND q.sample = x.sample AND q.o = b.other AND q.idx = x.idx - 1 WHERE x.idx > 0 AND (q.v IS NOT NULL OR x.idx - 1 > 2 + b.other % 2))"""


def _in_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once for each number of origins: the user's origin ``o``, the log ``log`` that users of all origins share, and the place in the own trace."""
    p = c.placed(spark, sf_dir).withColumn("n", F.explode(F.array(*map(F.lit, ORIGINS))))
    p = p.withColumn("o", F.pmod("user_id", F.col("n"))).withColumn("log", F.floor(F.col("user_id") / F.col("n")).cast("long"))
    return p.withColumn("model_id", F.concat(F.lit("n"), F.col("n").cast("string"))).withColumn("signal", F.concat(F.lit("F"), F.coalesce(F.col("o").cast("string"), F.lit("null")), F.lit("V"))).withColumn("v", F.when(F.col("value") >= c.CUT, "hi").otherwise("lo"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted observations of a network for each number of origins."""
    logs = checkpointed(_in_logs(spark, sf_dir).select("model_id", "log", "o", "signal", "pos", "v", "ts", "event_id"))
    trace = F.concat_ws("/", "model_id", F.col("log").cast("string"))
    steps = tr.steps(logs.select(trace.alias("user_id"), "ts", "event_id", F.col("signal").alias("event_type")))
    before = il.usual_before(steps.select(F.element_at(F.split("k", "/"), 1).alias("model_id"), "cur", "nxt"))
    size = 3 + F.col("o") % 2
    values = logs.select("model_id", "log", F.floor(F.col("pos") / size).alias("sample"), "signal", (F.col("pos") % size).cast("int").alias("idx"), F.col("v").alias("value"))
    return nw.counted(il.observations(values, checkpointed(il.structure(values, before))))


def _networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The networks' tables and vertices."""
    counts = checkpointed(_counts(spark, sf_dir))
    return checkpointed(nw.learned(counts)), checkpointed(nw.vertices(counts))


@query(
    "interleaved_counts",
    f"WITH {_NETS} SELECT 'n' || n AS model_id, 'F' || o || 'V_' || idx AS vertex, CASE WHEN idx = 0 THEN '' WHEN len(pv) = 1 THEN 'F' || o || 'V_' || (idx - 1) ELSE 'F' || o || 'V_' || (idx - 1) || ',F' || other || 'V_' || (idx - 1) END AS parents, array_to_string(pv, ',') AS parent_vals, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n, o, idx, pv), 9) AS p FROM ob GROUP BY n, o, idx, other, pv, outcome",
)
def _(spark, sf_dir):
    """What the networks of interleaved logs are learned from."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("model_id", "vertex", "parent_vals"))
    return _counts(spark, sf_dir).select("model_id", "vertex", F.array_join("parents", ",").alias("parents"), F.array_join("parent_vals", ",").alias("parent_vals"), "outcome", "n", F.round(p, 9).alias("p"))


def _invariants(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Invariants at or above 0.8 in logs of ``n`` origins, whose tokens begin with their origin."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    token = F.concat(F.lit("F"), text(F.pmod("user_id", F.lit(n))), F.lit("."), text(F.col("event_type")), F.when(F.col("value") >= c.CUT, ":hi").otherwise(":lo"))
    events = read(spark, sf_dir, "events").select(F.floor(F.col("user_id") / n).cast("long").alias("log"), "event_id", "ts", token.alias("event_type"))
    return tr.invariants(tr.pair_counts(events, "log", tr.by_time()), 0.8)


def _pairs_sql(n: int) -> str:
    """The counts of pairs in logs of n origins."""
    return f"""tok{n} AS MATERIALIZED (SELECT log AS k, 'F' || o || '.' || event_type || ':' || v AS t, row_number() OVER (PARTITION BY log ORDER BY ts, event_id) AS pos FROM logs WHERE n = {n}),
ends{n} AS (SELECT k, t, min(pos) AS first, max(pos) AS last FROM tok{n} GROUP BY ALL), total{n} AS (SELECT t, count(*) AS n FROM tok{n} GROUP BY t),
cnt{n} AS (SELECT x.t AS e, y.t AS k, count(*) FILTER (y.first < x.pos) AS earlier, count(*) FILTER (y.last > x.pos) AS later FROM tok{n} x JOIN ends{n} y ON x.k = y.k AND x.t <> y.t GROUP BY ALL),
pairs{n} AS (SELECT {n} AS n_models, a.t AS a, b.t AS b, a.n AS n_a, b.n AS n_b, coalesce(p.earlier, 0) AS precedes, coalesce(f.later, 0) AS follows FROM total{n} a JOIN total{n} b ON a.t <> b.t LEFT JOIN cnt{n} p ON p.k = a.t AND p.e = b.t LEFT JOIN cnt{n} f ON f.e = a.t AND f.k = b.t)"""


_ALL_PAIRS = f"{_IN_LOGS}, {', '.join(map(_pairs_sql, ORIGINS))}, pairs AS ({' UNION ALL '.join(f'SELECT * FROM pairs{n}' for n in ORIGINS)})"


@query(
    "invariants_by_models",
    f"WITH {_ALL_PAIRS}, found AS (SELECT n_models, 'precedes' AS kind, a, b FROM pairs WHERE precedes > 0 AND precedes / n_b >= 0.8 UNION ALL SELECT n_models, 'follows', a, b FROM pairs WHERE follows > 0 AND follows / n_a >= 0.8 UNION ALL SELECT n_models, 'not_followed', a, b FROM pairs WHERE follows = 0)"
    " SELECT n_models, kind, count(*) AS n, count(*) FILTER (substr(a, 1, 2) <> substr(b, 1, 2)) AS n_false FROM found GROUP BY ALL",
)
def _(spark, sf_dir):
    """How many invariants logs of two to five origins have, and how many of them are between origins."""
    return reduce(DataFrame.union, [tr.false_positives(_invariants(spark, sf_dir, n)).select(F.lit(n).alias("n_models"), "kind", "n", "n_false") for n in ORIGINS])


def false_specs(specs: DataFrame) -> DataFrame:
    """Rows (model_id, miner, n, n_false, n_loose): specifications, those that name signals of several origins, and those whose pattern matches more strings than paths were merged."""
    origins = F.size(F.array_distinct(F.regexp_extract_all("ltl", F.lit(r"F(\d+)V"), F.lit(1))))
    return specs.where("ltl IS NOT NULL").groupBy("model_id", "miner").agg(F.count("*").alias("n"), F.count(F.when(origins > 1, 1)).alias("n_false"), F.count(F.when(F.col("loose"), 1)).alias("n_loose"))


@query("false_positives_by_models")
def _(spark, sf_dir):
    """Specifications of both miners from logs of two to five origins, how many of them are between origins, and how many are loose (-1 for invariants, which have no pattern), beside
    the invariants of the same logs. The miners depend on the order of paths, so there is no SQL; invariants and networks have it (``invariants_by_models``, ``interleaved_counts``)."""
    t, v = networks = _networks(spark, sf_dir)
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    paths = pt.below(nw.edge_weights(t, nw.marginals(t, LONGEST)), nw.boundary_edges(v), states, c.THETA, LONGEST - 1)
    order = Window.partitionBy("model_id").orderBy(F.round("metric", 12), F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["v"], x["val"])), ","))
    paths = checkpointed(paths.select("model_id", "nodes", "tokens", "metric", (F.row_number().over(order) - 1).alias("path_id")))
    found, judges = cm._mined_of(networks, paths, LONGEST)
    both = cm._judged(found, judges).withColumn("miner", F.lit("comparison")).union(mining.metric_based(found).withColumn("miner", F.lit("metric")))
    own = false_specs(cm._named(both)).select(F.substring("model_id", 2, 9).cast("int").alias("n_models"), "miner", "n", "n_false", "n_loose")
    kinds = [tr.false_positives(_invariants(spark, sf_dir, n)).agg(F.sum("n").alias("n"), F.sum("n_false").alias("n_false")).select(F.lit(n).alias("n_models"), F.lit("invariants").alias("miner"), "n", "n_false", F.lit(-1).cast("long").alias("n_loose")) for n in ORIGINS]
    return reduce(DataFrame.union, kinds, own)
