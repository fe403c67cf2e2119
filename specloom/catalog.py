"""All registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import completed, token_distance
from .operators import boolfn as bf
from .operators import edit as ed
from .operators import factors as fc
from .operators import graphs as gr
from .operators import logic as lg
from .operators import network as nw
from .operators import paths as pt
from .operators import patterns
from .operators import sampling as sm
from .operators import traces as tr
from .plans import mining
from .sources.tables import checkpointed, read, work_path
from .streaming import windows

LENGTH, CUT, MODELS = 5, 115, 4
THETA = 0.7

# ---- SQL that several queries share

SEQ = "seq AS MATERIALIZED (SELECT user_id, event_id, ts, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS pos FROM events)"
SLOT = f"""slot AS MATERIALIZED (SELECT 'm' || (user_id % {MODELS}) AS model_id, user_id, pos // {LENGTH} AS s, (pos % {LENGTH})::INT AS k, event_type AS e,
  CASE WHEN value >= {CUT} THEN 'hi' ELSE 'lo' END AS v FROM seq QUALIFY count(*) OVER (PARTITION BY user_id, pos // {LENGTH}) = {LENGTH})"""
OBS = """obs AS MATERIALIZED (SELECT model_id, 'E_' || k AS vertex, 'E' AS signal, k, [] AS pv, e AS outcome FROM slot WHERE k = 0
  UNION ALL SELECT model_id, 'V_' || k, 'V', k, [], v FROM slot WHERE k = 0
  UNION ALL SELECT b.model_id, 'E_' || b.k, 'E', b.k, [a.e], b.e FROM slot a JOIN slot b ON a.user_id = b.user_id AND a.s = b.s AND b.k = a.k + 1
  UNION ALL SELECT b.model_id, 'V_' || b.k, 'V', b.k, [a.v, a.e], b.v FROM slot a JOIN slot b ON a.user_id = b.user_id AND a.s = b.s AND b.k = a.k + 1)"""
CPT = """val AS (SELECT DISTINCT model_id, signal, outcome FROM obs),
cnt AS (SELECT model_id, vertex, signal, k, pv, outcome, count(*) AS n FROM obs GROUP BY ALL),
vert AS (SELECT DISTINCT model_id, vertex, signal, k FROM obs),
combo AS (SELECT model_id, vertex, signal, k, []::VARCHAR[] AS pv FROM vert WHERE k = 0
  UNION ALL SELECT x.model_id, vertex, x.signal, k, [e.outcome] FROM vert x JOIN val e ON e.model_id = x.model_id AND e.signal = 'E' WHERE k > 0 AND x.signal = 'E'
  UNION ALL SELECT x.model_id, vertex, x.signal, k, [v.outcome, e.outcome] FROM vert x JOIN val e ON e.model_id = x.model_id AND e.signal = 'E' JOIN val v ON v.model_id = x.model_id AND v.signal = 'V' WHERE k > 0 AND x.signal = 'V'),
grid AS (SELECT c.*, o.outcome FROM combo c JOIN val o ON o.model_id = c.model_id AND o.signal = c.signal),
cpt AS MATERIALIZED (SELECT g.model_id, g.vertex, g.signal, g.k, g.pv, g.outcome,
  CASE WHEN sum(n) OVER w IS NULL THEN 1.0 / count(*) OVER w ELSE coalesce(n, 0) / sum(n) OVER w END::DOUBLE AS p
  FROM grid g LEFT JOIN cnt c ON c.model_id = g.model_id AND c.vertex = g.vertex AND c.pv = g.pv AND c.outcome = g.outcome WINDOW w AS (PARTITION BY g.model_id, g.vertex, g.pv))"""
LEARN = f"{SEQ}, {SLOT}, {OBS}, {CPT}"
_LEVELS = ["m0 AS MATERIALIZED (SELECT model_id, k, signal, outcome, p FROM cpt WHERE k = 0)"]
for _k in range(1, LENGTH):
    _LEVELS.append(
        f"m{_k} AS MATERIALIZED (SELECT c.model_id, c.k, c.signal, c.outcome, sum(c.p * e.p) AS p FROM cpt c JOIN m{_k - 1} e ON e.model_id = c.model_id AND e.signal = 'E' AND c.pv[1] = e.outcome WHERE c.k = {_k} AND c.signal = 'E' GROUP BY ALL"
        f" UNION ALL SELECT c.model_id, c.k, c.signal, c.outcome, sum(c.p * v.p * e.p) FROM cpt c JOIN m{_k - 1} v ON v.model_id = c.model_id AND v.signal = 'V' AND c.pv[1] = v.outcome JOIN m{_k - 1} e ON e.model_id = c.model_id AND e.signal = 'E' AND c.pv[2] = e.outcome WHERE c.k = {_k} AND c.signal = 'V' GROUP BY ALL)"
    )
MARGINALS = ", ".join(_LEVELS) + ", marg AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(LENGTH)) + ")"
WEIGHTS = """wt AS MATERIALIZED (SELECT model_id, 'E' AS ss, k - 1 AS sk, pv[1] AS sv, 'E' AS ds, k AS dk, outcome AS dv, p FROM cpt WHERE signal = 'E' AND k > 0
  UNION ALL SELECT c.model_id, 'V', c.k - 1, c.pv[1], 'V', c.k, c.outcome, sum(c.p * m.p) FROM cpt c JOIN marg m ON m.model_id = c.model_id AND m.k = c.k - 1 AND m.signal = 'E' AND m.outcome = c.pv[2] WHERE c.signal = 'V' AND c.k > 0 GROUP BY ALL
  UNION ALL SELECT c.model_id, 'E', c.k - 1, c.pv[2], 'V', c.k, c.outcome, sum(c.p * m.p) FROM cpt c JOIN marg m ON m.model_id = c.model_id AND m.k = c.k - 1 AND m.signal = 'V' AND m.outcome = c.pv[1] WHERE c.signal = 'V' AND c.k > 0 GROUP BY ALL)"""
NETWORK = f"{LEARN}, {MARGINALS}, {WEIGHTS}"

# ---- what several queries start from


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.positions(read(spark, sf_dir, "events"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("m"), F.pmod("user_id", F.lit(MODELS)).cast("string"))
    return nw.counted(nw.observations(tr.samples(placed(spark, sf_dir), LENGTH), model, CUT, LENGTH))


def cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.learned(counts(spark, sf_dir))


def rounded(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def joined(name: str):
    return F.array_join(name, ",").alias(name)


def cpt_rows(t: DataFrame) -> DataFrame:
    return t.select("model_id", "vertex", joined("parent_vals"), "outcome", *rounded("p"))


QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- traces and invariants


@query("trace_sequences", f"WITH {SEQ} SELECT user_id, pos, event_type, value FROM seq")
def _(spark, sf_dir):
    return placed(spark, sf_dir).select("user_id", "pos", "event_type", "value")


@query("transition_cpt", f"WITH {SEQ}, n AS (SELECT a.event_type AS cur, b.event_type AS nxt, count(*) AS n FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.pos = a.pos + 1 GROUP BY ALL) SELECT cur, nxt, n, round(n / sum(n) OVER (PARTITION BY cur), 9) AS p, round(1 - n / sum(n) OVER (PARTITION BY cur), 9) AS w FROM n")
def _(spark, sf_dir):
    return tr.transition_cpt(tr.steps(read(spark, sf_dir, "events"))).select("cur", "nxt", "n", *rounded("p", "w"))


def _tokens(spark, sf_dir):
    """Traces of (event type, hi or lo) tokens."""
    hi = F.when(F.col("value") >= CUT, "hi").otherwise("lo")
    return placed(spark, sf_dir).withColumn("event_type", F.concat_ws(":", "event_type", hi))


PAIRS = f"""{SEQ}, tok AS (SELECT user_id, pos, event_type || ':' || CASE WHEN value >= {CUT} THEN 'hi' ELSE 'lo' END AS t FROM seq),
ends AS (SELECT user_id, t, min(pos) AS first, max(pos) AS last FROM tok GROUP BY ALL),
total AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
cnt AS (SELECT x.t AS e, y.t AS k, count(*) FILTER (y.first < x.pos) AS earlier, count(*) FILTER (y.last > x.pos) AS later FROM tok x JOIN ends y ON x.user_id = y.user_id AND x.t <> y.t GROUP BY ALL),
pairs AS (SELECT a.t AS a, b.t AS b, a.n AS n_a, b.n AS n_b, coalesce(p.earlier, 0) AS precedes, coalesce(f.later, 0) AS follows FROM total a JOIN total b ON a.t <> b.t LEFT JOIN cnt p ON p.k = a.t AND p.e = b.t LEFT JOIN cnt f ON f.e = a.t AND f.k = b.t)"""
FOUND = f"""{PAIRS}, found AS (SELECT 'precedes' AS kind, a, b, precedes / n_b AS ratio FROM pairs WHERE precedes > 0 AND precedes / n_b >= 0.8
  UNION ALL SELECT 'follows', a, b, follows / n_a FROM pairs WHERE follows > 0 AND follows / n_a >= 0.8 UNION ALL SELECT 'not_followed', a, b, NULL FROM pairs WHERE follows = 0)"""


def _found(spark, sf_dir):
    return tr.invariants(tr.pair_counts(_tokens(spark, sf_dir)), 0.8)


@query("invariant_counts", f"WITH {PAIRS} SELECT * FROM pairs")
def _(spark, sf_dir):
    return tr.pair_counts(_tokens(spark, sf_dir))


for _kind in ("precedes", "follows", "not_followed"):

    @query(f"invariant_{_kind}", f"WITH {FOUND} SELECT a, b, round(ratio, 9) AS ratio FROM found WHERE kind = '{_kind}'")
    def _(spark, sf_dir, kind=_kind):
        return _found(spark, sf_dir).where(F.col("kind") == kind).select("a", "b", *rounded("ratio"))


@query("invariant_summary", f"WITH {FOUND} SELECT kind, CASE kind WHEN 'precedes' THEN 2 WHEN 'follows' THEN 3 ELSE 4 END AS height, 2 AS leaves, count(*) AS n FROM found GROUP BY kind")
def _(spark, sf_dir):
    return tr.invariant_summary(_found(spark, sf_dir))


@query("invariant_false_positives", f"WITH {FOUND} SELECT kind, count(*) AS n, count(*) FILTER (substr(a, 1, 2) <> substr(b, 1, 2)) AS n_false FROM found GROUP BY kind")
def _(spark, sf_dir):
    return tr.false_positives(_found(spark, sf_dir))


@query(
    "interval_reconstruct",
    f"WITH {SEQ}, t AS (SELECT user_id, pos, event_type, epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER u / 1e6 AS s, (max(epoch_us(ts)) OVER u / 1e6 - min(epoch_us(ts)) OVER u / 1e6) * 1.5 AS over_ FROM seq WINDOW u AS (PARTITION BY user_id))"
    ' SELECT user_id, pos, event_type, round(s, 3) AS "start", round(coalesce(lead(s) OVER (PARTITION BY user_id, event_type ORDER BY pos), over_), 3) AS "end" FROM t',
)
def _(spark, sf_dir):
    return tr.intervals(placed(spark, sf_dir)).select("user_id", "pos", "event_type", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(
    "trace_chunk",
    f"WITH {SEQ}, s AS (SELECT user_id, pos // {LENGTH} AS sample, pos, event_type FROM seq QUALIFY count(*) OVER (PARTITION BY user_id, pos // {LENGTH}) = {LENGTH}),"
    " c AS (SELECT *, sample // 3 AS trace, count(*) OVER (PARTITION BY user_id, sample // 3) AS n FROM s)"
    f" SELECT user_id, trace, sample, (row_number() OVER (PARTITION BY user_id, trace ORDER BY pos) - 1)::INT AS pos_in_trace, event_type FROM c WHERE n = 3 * {LENGTH}",
)
def _(spark, sf_dir):
    return tr.chunks(tr.samples(placed(spark, sf_dir), LENGTH), 3)


@query("trace_interleave", "WITH t AS (SELECT strftime(ts, '%Y-%m-%d %H') || '/' || ((user_id // 2) % 8) AS log, 'F' || (user_id % 2) || '.' || event_type AS token, ts, event_id FROM events) SELECT log, (row_number() OVER (PARTITION BY log ORDER BY ts, event_id) - 1)::INT AS pos, token FROM t")
def _(spark, sf_dir):
    return tr.interleaved(read(spark, sf_dir, "events"), 2)


# ---- learning and changing distributions


@query("learn_cpt_chain", f"WITH {LEARN} SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome, round(p, 9) AS p FROM cpt")
def _(spark, sf_dir):
    return cpt_rows(cpt(spark, sf_dir))


_NAN = """WITH ty AS (SELECT DISTINCT event_type AS t FROM events), c AS (SELECT user_id, ts::DATE AS day, event_type AS t, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT u.user_id, u.day, ty.t, c.n, sum(c.n) OVER (PARTITION BY u.user_id, u.day) AS total FROM (SELECT DISTINCT user_id, day FROM c) u JOIN ty ON true LEFT JOIN c ON c.user_id = u.user_id AND c.day = u.day AND c.t = ty.t),
p AS (SELECT user_id, day, t, n / (total + 1) AS p, sum(n / (total + 1)) OVER w AS s, count(n) OVER w AS known, count(*) OVER w AS size FROM g WINDOW w AS (PARTITION BY user_id, day))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, t AS event_type, round(CASE WHEN known = size THEN p WHEN p IS NULL THEN {missing} ELSE {present} END, 9) AS p FROM p"""


def _incomplete(spark, sf_dir):
    """For each user and day the share of each event type, missing where there was none, out of one more event than there were."""
    events = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    n = events.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))
    types = events.agg(F.array_sort(F.collect_set("event_type")).alias("types"))  # a row
    own = n.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("own"), F.sum("n").alias("total"))
    return own.join(F.broadcast(types), F.lit(True)).withColumn("p", F.transform("types", lambda t: F.try_element_at("own", t) / (F.col("total") + 1)))


for _name, _missing, _present in (("tozero1", "0", "p + (1 - s) / known"), ("tozero2", "0", "p / s"), ("split", "(1 - s) / (size - known)", "p")):

    @query(f"nan_{_name}", _NAN.format(missing=_missing, present=_present))
    def _(spark, sf_dir, strategy=_name):
        t = _incomplete(spark, sf_dir).select("user_id", "day", F.explode(F.arrays_zip("types", completed(F.col("p"), strategy).alias("q"))).alias("x"))
        return t.select("user_id", "day", F.col("x.types").alias("event_type"), F.round("x.q", 9).alias("p"))


@query("force_initial_state", f"WITH {LEARN} SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome, round(CASE WHEN k = 0 AND signal = 'E' THEN (outcome = 'view')::INT ELSE p END, 9) AS p FROM cpt")
def _(spark, sf_dir):
    return cpt_rows(nw.force_initial(cpt(spark, sf_dir), "view"))


@query("without_initial_state", f"WITH {LEARN} SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome, round(CASE WHEN k = 0 THEN (CASE WHEN outcome = 'view' THEN 0 ELSE p END) / sum(CASE WHEN outcome = 'view' THEN 0 ELSE p END) OVER (PARTITION BY model_id, vertex, pv) ELSE p END, 9) AS p FROM cpt")
def _(spark, sf_dir):
    return cpt_rows(nw.without_initial(cpt(spark, sf_dir), "view"))


@query(
    "state_change_diagonal",
    f"WITH {LEARN}, r AS (SELECT *, sum(CASE WHEN k > 0 AND outcome = pv[1] THEN 0 ELSE p END) OVER w AS rest, count(*) FILTER (k = 0 OR outcome <> pv[1]) OVER w AS others FROM cpt WINDOW w AS (PARTITION BY model_id, vertex, pv))"
    " SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome, round(CASE WHEN k = 0 THEN p WHEN outcome = pv[1] THEN 0.7 WHEN rest > 0 THEN p * 0.3 / rest ELSE 0.3 / others END, 9) AS p FROM r",
)
def _(spark, sf_dir):
    return cpt_rows(nw.state_change(cpt(spark, sf_dir), 0.3))


@query(
    "edge_removal_marginalise",
    f"WITH {LEARN}, a AS (SELECT model_id, vertex, CASE WHEN signal = 'V' THEN pv[1:1] ELSE pv END AS pv, outcome, avg(p) AS p FROM cpt GROUP BY ALL)"
    " SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome, round(p / sum(p) OVER (PARTITION BY model_id, vertex, pv), 9) AS p FROM a",
)
def _(spark, sf_dir):
    t = cpt(spark, sf_dir)
    gone = nw.cross_edges(nw.edges(t.select("model_id", "vertex", "parents").distinct()))
    return cpt_rows(nw.without_edges(t, gone))


# ---- network structure


@query("vertex_naming_check", f"WITH {SEQ}, {SLOT} SELECT DISTINCT model_id, true AS consistent FROM slot")
def _(spark, sf_dir):
    return nw.naming_check(nw.vertices(counts(spark, sf_dir)))


_CHAIN = f"WITH {SEQ}, {SLOT}, m AS (SELECT DISTINCT model_id FROM slot), k AS (SELECT unnest(range({LENGTH}))::INT AS k), s AS (SELECT unnest(['E', 'V']) AS s)"


@query("start_terminal_edges", f"{_CHAIN} SELECT model_id, 'start' AS src, s || '_0' AS dst FROM m, s UNION ALL SELECT model_id, s || '_{LENGTH - 1}', 'terminal' FROM m, s")
def _(spark, sf_dir):
    return nw.boundary_edges(nw.vertices(counts(spark, sf_dir)))


@query("cross_edges", f"{_CHAIN} SELECT model_id, 'E_' || k AS src, 'V_' || (k + 1) AS dst FROM m, k WHERE k < {LENGTH - 1}")
def _(spark, sf_dir):
    return nw.cross_edges(nw.edges(nw.vertices(counts(spark, sf_dir))))


@query("topo_depth", f"{_CHAIN} SELECT model_id, s || '_' || k AS vertex, k AS depth FROM m, s, k")
def _(spark, sf_dir):
    v = nw.vertices(counts(spark, sf_dir))
    return nw.depths(nw.edges(v), v.select("model_id", "vertex"), LENGTH)


_E, _V = "count(DISTINCT e)", "count(DISTINCT v)"
_N = [f"v{k} AS (SELECT model_id, ne, nv, nv * {'1' if k == LENGTH - 1 else 'lv'} AS lv, ne * {'1' if k == LENGTH - 1 else '(le + lv)'} AS le FROM {'z' if k == LENGTH - 1 else f'v{k + 1}'})" for k in reversed(range(LENGTH))]


@query("dag_path_count", f"WITH {SEQ}, {SLOT}, z AS (SELECT model_id, {_E} AS ne, {_V} AS nv FROM slot GROUP BY model_id), {', '.join(_N)} SELECT model_id, (le + lv)::BIGINT AS n FROM v0")
def _(spark, sf_dir):
    v = nw.vertices(counts(spark, sf_dir))
    return nw.path_count(v, LENGTH)


@query("marginals_independent", f"WITH {LEARN}, {MARGINALS} SELECT model_id, signal || '_' || k AS vertex, outcome, round(p, 9) AS p FROM marg")
def _(spark, sf_dir):
    return nw.marginals(cpt(spark, sf_dir), LENGTH).select("model_id", "vertex", "outcome", *rounded("p"))


@query("edge_weights", f"WITH {NETWORK} SELECT model_id, ss || '_' || sk AS src, sv AS src_val, ds || '_' || dk AS dst, dv AS dst_val, round(p, 9) AS p, round(least(greatest(1 - p, 0), 1), 9) AS w FROM wt")
def _(spark, sf_dir):
    t = checkpointed(cpt(spark, sf_dir))
    return nw.edge_weights(t, nw.marginals(t, LENGTH)).select("model_id", "src", "src_val", "dst", "dst_val", *rounded("p", "w"))


# ---- factors


def _factors(spark, sf_dir, *names):
    t = checkpointed(cpt(spark, sf_dir))
    k = lambda n: int(n[2:])
    parents = lambda n: [] if k(n) == 0 else [f"V_{k(n) - 1}", f"E_{k(n) - 1}"] if n[0] == "V" else [f"E_{k(n) - 1}"]
    return [fc.factor(t, n, parents(n)) for n in names]


_E0, _V1 = "(SELECT model_id, outcome AS E_0, p FROM cpt WHERE vertex = 'E_0')", "(SELECT model_id, outcome AS V_1, pv[1] AS V_0, pv[2] AS E_0, p FROM cpt WHERE vertex = 'V_1')"


@query("factor_product", f'WITH {LEARN} SELECT model_id, "V_1", "V_0", "E_0", round(b.p * a.p, 9) AS p FROM {_V1} b JOIN {_E0} a USING (model_id, E_0)')
def _(spark, sf_dir):
    a, b = _factors(spark, sf_dir, "V_1", "E_0")
    return fc.multiply(a, b).select("model_id", "V_1", "V_0", "E_0", *rounded("p"))


@query("factor_sumout", f'WITH {LEARN} SELECT model_id, "V_1", "V_0", round(sum(b.p * a.p), 9) AS p FROM {_V1} b JOIN {_E0} a USING (model_id, E_0) GROUP BY ALL')
def _(spark, sf_dir):
    a, b = _factors(spark, sf_dir, "V_1", "E_0")
    return fc.sum_out(fc.multiply(a, b), "E_0").select("model_id", "V_1", "V_0", *rounded("p"))


@query("factor_reduce", f"WITH {LEARN} SELECT model_id, \"V_1\", \"V_0\", round(p, 9) AS p FROM {_V1} WHERE E_0 = 'view'")
def _(spark, sf_dir):
    return fc.reduce(_factors(spark, sf_dir, "V_1")[0], "E_0", "view").select("model_id", "V_1", "V_0", *rounded("p"))


_VE = f"""{LEARN}, e1 AS (SELECT model_id, outcome AS e1, p FROM cpt WHERE vertex = 'E_1' AND pv[1] = 'view'), v1 AS (SELECT model_id, outcome AS v1, p FROM cpt WHERE vertex = 'V_1' AND pv[1] = 'lo' AND pv[2] = 'view'),
j AS (SELECT c.model_id, c.outcome AS v2, sum(c.p * e1.p * v1.p) AS p FROM cpt c JOIN e1 ON e1.model_id = c.model_id AND c.pv[2] = e1 JOIN v1 ON v1.model_id = c.model_id AND c.pv[1] = v1 WHERE c.vertex = 'V_2' GROUP BY ALL)"""


@query("ve_condprob", f'WITH {_VE} SELECT model_id, v2 AS "V_2", round(p / sum(p) OVER (PARTITION BY model_id), 9) AS p FROM j')
def _(spark, sf_dir):
    f = _factors(spark, sf_dir, "E_0", "V_0", "E_1", "V_1", "V_2")
    return fc.conditional(f, ["V_2"], {"E_0": "view", "V_0": "lo"}).select("model_id", "V_2", *rounded("p"))


@query("ve_specific_query", f"WITH {LEARN}, j AS (SELECT b.model_id, b.outcome AS e2, sum(a.p * b.p) AS p FROM cpt a JOIN cpt b ON a.model_id = b.model_id AND a.vertex = 'E_1' AND b.vertex = 'E_2' AND b.pv[1] = a.outcome WHERE a.pv[1] = 'view' GROUP BY ALL) SELECT model_id, round(sum(p) FILTER (e2 IN ('click', 'error')) / sum(p), 9) AS p FROM j GROUP BY model_id")
def _(spark, sf_dir):
    f = _factors(spark, sf_dir, "E_0", "E_1", "E_2")
    return fc.specific(f, {"E_2": ["click", "error"]}, {"E_0": "view"}).select("model_id", *rounded("p"))


# ---- paths and edit distances

_LAST = LENGTH - 1
PATHS = f"""{NETWORK}, walk AS (SELECT model_id, signal AS s, k, outcome AS v, [signal || ':' || outcome] AS tokens, [signal] AS signals, 0 AS n, 0::DOUBLE AS w FROM (SELECT DISTINCT model_id, signal, k, outcome FROM cpt WHERE k = 0)
  UNION ALL SELECT a.model_id, b.ds, b.dk, b.dv, list_append(a.tokens, b.ds || ':' || b.dv), list_append(a.signals, b.ds), a.n + 1, a.w + (1 - b.p) FROM walk a JOIN wt b ON a.model_id = b.model_id AND a.s = b.ss AND a.k = b.sk AND a.v = b.sv),
path AS MATERIALIZED (SELECT model_id, tokens, signals, w / n AS metric FROM walk WHERE k = {_LAST} AND w / n <= 1 - {THETA}),
num AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY model_id ORDER BY round(metric, 12), array_to_string(tokens, ',')) - 1)::INT AS path_id FROM path)"""


def _learned(spark, sf_dir):
    """The networks: their tables and their vertices."""
    c = checkpointed(counts(spark, sf_dir))
    return checkpointed(nw.learned(c)), checkpointed(nw.vertices(c))


def _paths(spark, sf_dir, min_signals=1, networks=None):
    t, v = networks or _learned(spark, sf_dir)
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    w = nw.edge_weights(t, nw.marginals(t, LENGTH))
    return pt.below(w, nw.boundary_edges(v), states, THETA, LENGTH - 1, 2, min_signals)


def _numbered(spark, sf_dir, networks=None):
    order = Window.partitionBy("model_id").orderBy(F.round("metric", 12), joined("tokens"))
    return checkpointed(_paths(spark, sf_dir, networks=networks).select("model_id", "nodes", "tokens", "metric", (F.row_number().over(order) - 1).alias("path_id")))


@query("paths_threshold", f"WITH RECURSIVE {PATHS} SELECT model_id, array_to_string(tokens, ',') AS tokens, round(metric, 9) AS metric FROM path")
def _(spark, sf_dir):
    return _paths(spark, sf_dir).select("model_id", joined("tokens"), *rounded("metric"))


@query("paths_min_signals", f"WITH RECURSIVE {PATHS} SELECT model_id, array_to_string(tokens, ',') AS tokens, round(metric, 9) AS metric FROM path WHERE len(list_distinct(signals)) >= 2")
def _(spark, sf_dir):
    return _paths(spark, sf_dir, 2).select("model_id", joined("tokens"), *rounded("metric"))


@query("best_path_min_avg", f"WITH RECURSIVE {PATHS} SELECT model_id, n AS n_edges, round(min(w / n), 9) AS metric FROM walk WHERE k = {_LAST} GROUP BY ALL")
def _(spark, sf_dir):
    c = checkpointed(counts(spark, sf_dir))
    t, v = checkpointed(nw.learned(c)), nw.vertices(c)
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    return pt.best(nw.edge_weights(t, nw.marginals(t, LENGTH)), nw.boundary_edges(v), states, LENGTH - 1).select("model_id", "n_edges", *rounded("metric"))


_CODE = f"""{PATHS}, alpha AS MATERIALIZED (SELECT model_id, list_sort(list_distinct(flatten(list(tokens)))) AS a FROM num GROUP BY model_id),
code AS MATERIALIZED (SELECT model_id, path_id, array_to_string(list_transform(tokens, lambda t: chr((64 + list_position(a, t))::INT)), '') AS c FROM num JOIN alpha USING (model_id)),
dist AS (SELECT x.model_id, x.path_id AS a, y.path_id AS b, levenshtein(x.c, y.c)::INT AS d FROM code x JOIN code y USING (model_id))"""


def _distances(spark, sf_dir):
    return ed.confusion(_numbered(spark, sf_dir))


@query("levenshtein_confusion", f"WITH RECURSIVE {_CODE} SELECT model_id, a, b, d FROM dist")
def _(spark, sf_dir):
    return _distances(spark, sf_dir)


@query("nearest_paths_order", f"WITH RECURSIVE {_CODE} SELECT model_id, a, b, (row_number() OVER (PARTITION BY model_id, a ORDER BY d, b) - 1)::INT AS place FROM dist")
def _(spark, sf_dir):
    return ed.merge_order(_distances(spark, sf_dir))


@query(
    "levenshtein_tokens_hof",
    f"WITH {SEQ}, t AS (SELECT user_id, pos // {LENGTH} AS s, string_agg(chr((64 + list_position((SELECT list_sort(list(DISTINCT event_type)) FROM events), event_type))::INT), '' ORDER BY pos) AS c FROM seq GROUP BY ALL HAVING count(*) = {LENGTH})"
    " SELECT a.user_id, a.s AS sample, levenshtein(a.c, b.c)::INT AS d FROM t a JOIN t b ON a.user_id = b.user_id AND b.s = a.s + 1",
)
def _(spark, sf_dir):
    s = tr.samples(placed(spark, sf_dir), LENGTH).select("user_id", "sample", F.col("events.event_type").alias("x"))
    nxt = s.select("user_id", (F.col("sample") - 1).alias("sample"), F.col("x").alias("y"))
    return s.join(nxt, ["user_id", "sample"]).select("user_id", "sample", token_distance(F.col("x"), F.col("y")).cast("int").alias("d"))


# ---- labelled transition systems

HOURS, SHARE = 3, 0.04
KRIPKE = f"""{SEQ}, st AS (SELECT user_id, pos, event_type || ':' || (hour(ts) // {HOURS}) AS st, event_type, hour(ts) // {HOURS} AS slot FROM seq),
states AS (SELECT DISTINCT st AS state FROM st), labels AS (SELECT DISTINCT st AS state, event_type AS ap FROM st UNION SELECT DISTINCT st, 'slot' || slot FROM st),
step AS (SELECT a.st AS src, b.st AS dst, count(*) AS n FROM st a JOIN st b ON a.user_id = b.user_id AND b.pos = a.pos + 1 GROUP BY ALL),
strong AS (SELECT src, dst FROM (SELECT *, sum(n) OVER (PARTITION BY src) AS total FROM step) WHERE n >= {SHARE} * total),
trans AS (SELECT * FROM strong UNION ALL SELECT state, state FROM states WHERE state NOT IN (SELECT src FROM strong))"""


def _strong(spark, sf_dir):
    p = read(spark, sf_dir, "events").withColumn("event_type", F.concat_ws(":", "event_type", F.floor(F.hour("ts") / HOURS)))
    n = tr.steps(p).groupBy(F.col("cur").alias("src"), F.col("nxt").alias("dst")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    return checkpointed(n.withColumn("total", total).where(F.col("n") >= SHARE * F.col("total")).select("src", "dst"))


def _kripke(spark, sf_dir, strong=None):
    slot = F.floor(F.hour("ts") / HOURS)
    states = read(spark, sf_dir, "events").select("event_type", slot.alias("slot")).distinct().withColumn("state", F.concat_ws(":", "event_type", "slot"))
    states = checkpointed(states)
    labels = states.select("state", F.explode(F.array("event_type", F.concat(F.lit("slot"), F.col("slot").cast("string")))).alias("ap"))
    strong = _strong(spark, sf_dir) if strong is None else strong
    loops = states.select("state").join(strong.select(F.col("src").alias("state")), "state", "left_anti").select(F.col("state").alias("src"), F.col("state").alias("dst"))
    return lg.Kripke(states.select("state"), checkpointed(strong.union(loops)), checkpointed(labels)).checked()


@query("kripke_transitions", f"WITH {KRIPKE} SELECT src, dst FROM trans")
def _(spark, sf_dir):
    return _kripke(spark, sf_dir).transitions


def _walk_sql(through: str, goal: str) -> str:
    """States of a way through states of ``through`` to one of ``goal`` (which needn't be of ``through`` itself)."""
    return f"WITH RECURSIVE r AS (SELECT state FROM ({goal}) UNION SELECT t.src FROM r JOIN trans t ON t.dst = r.state WHERE t.src IN ({through})) SELECT state FROM r"


def _endless_sql(within: str) -> str:
    """States with an endless way within a set: those that reach a cycle there."""
    inner = f"SELECT src AS x, dst AS y FROM trans WHERE src IN ({within}) AND dst IN ({within})"
    return f"WITH RECURSIVE c AS ({inner} UNION SELECT c.x, i.y FROM c JOIN ({inner}) i ON i.x = c.y) SELECT DISTINCT x AS state FROM (SELECT x, y FROM c UNION SELECT x, x FROM c) z WHERE y IN (SELECT x FROM c WHERE x = y)"


def _sat_sql(f) -> str:
    """SQL for the states of a formula, each operator by what it says about ways."""
    if f == lg.TRUE:
        return "SELECT state FROM states"
    if isinstance(f, str):
        return f"SELECT state FROM labels WHERE ap = '{f}'"
    op, *args = f
    a, b = ([_sat_sql(x) for x in args] + [""])[:2]
    outside = lambda x: f"SELECT state FROM states WHERE state NOT IN ({x})"
    both = lambda x, y: f"SELECT state FROM ({x}) WHERE state IN ({y})"
    either = lambda x, y: f"SELECT state FROM ({x}) UNION SELECT state FROM ({y})"
    neither = f"SELECT state FROM states WHERE state NOT IN ({a}) AND state NOT IN ({b})" if b else ""
    return {
        "not": lambda: outside(a),
        "or": lambda: either(a, b),
        "and": lambda: both(a, b),
        "imply": lambda: f"SELECT state FROM states WHERE state NOT IN ({a}) OR state IN ({b})",
        "EX": lambda: f"SELECT DISTINCT src AS state FROM trans WHERE dst IN ({a})",
        "AX": lambda: f"SELECT state FROM states WHERE NOT EXISTS (SELECT 1 FROM trans WHERE src = state AND dst NOT IN ({a}))",
        "EF": lambda: _walk_sql("SELECT state FROM states", a),
        "EG": lambda: _endless_sql(a),
        "EU": lambda: _walk_sql(a, b),
        "EW": lambda: either(_walk_sql(a, b), _endless_sql(a)),  # a until b, or a for ever
        "ER": lambda: either(_walk_sql(b, both(a, b)), _endless_sql(b)),  # b up to a state with both, or b for ever
        "AF": lambda: outside(_endless_sql(outside(a))),  # no way stays outside a for ever
        "AG": lambda: outside(_walk_sql("SELECT state FROM states", outside(a))),  # no way leads out of a
        "AU": lambda: outside(either(_walk_sql(outside(b), neither), _endless_sql(outside(b)))),  # no way leaves both before b, none avoids b for ever
        "AW": lambda: outside(_walk_sql(outside(b), neither)),
        "AR": lambda: outside(_walk_sql(outside(a), outside(b))),  # no way leaves b before a
    }[op]()


FORMULAS = {
    "ap": "purchase", "not": ("not", "purchase"), "or": ("or", "purchase", "slot0"), "and": ("and", "purchase", "slot0"), "imply": ("imply", "purchase", "slot0"),
    "ex": ("EX", "purchase"), "ax": ("AX", ("or", "purchase", "view")), "ef": ("EF", ("and", "error", "slot7")), "af": ("AF", "error"), "eg": ("EG", ("not", "error")), "ag": ("AG", ("not", ("and", "error", "slot7"))),
    "eu": ("EU", ("not", "error"), ("and", "purchase", "slot3")), "au": ("AU", ("not", "error"), "purchase"), "er": ("ER", "purchase", ("not", "error")), "ar": ("AR", "purchase", ("not", "error")), "ew": ("EW", ("not", "error"), "purchase"), "aw": ("AW", ("not", "error"), "purchase"),
    "option": ("EU", "view", ("and", "click", ("EX", "purchase"))),
}
for _name, _formula in FORMULAS.items():

    @query(f"ctl_{_name}", f"WITH {KRIPKE} SELECT state FROM ({_sat_sql(_formula)})")
    def _(spark, sf_dir, formula=_formula):
        return _kripke(spark, sf_dir).sat(formula)


_CLOSURE = "clo AS (SELECT src AS x, dst AS y FROM strong UNION SELECT clo.x, s.dst FROM clo JOIN strong s ON s.src = clo.y)"


@query("ctl_fair", f"WITH RECURSIVE {KRIPKE}, c AS (SELECT src AS x, dst AS y FROM trans UNION SELECT c.x, t.dst FROM c JOIN trans t ON t.src = c.y), good AS (SELECT DISTINCT a.x FROM c a WHERE a.x = a.y AND EXISTS (SELECT 1 FROM c b JOIN c d ON b.x = d.y AND b.y = d.x JOIN labels l ON l.state = b.y AND l.ap = 'purchase' WHERE b.x = a.x)) SELECT x AS state FROM good UNION SELECT x FROM c WHERE y IN (SELECT x FROM good)")
def _(spark, sf_dir):
    return _kripke(spark, sf_dir).fair_states(["purchase"])


@query("reachable_set", f"WITH RECURSIVE {KRIPKE}, r AS (SELECT state AS node FROM labels WHERE ap = 'signup' UNION SELECT s.dst FROM r JOIN strong s ON s.src = r.node) SELECT node FROM r")
def _(spark, sf_dir):
    strong = _strong(spark, sf_dir)
    k = _kripke(spark, sf_dir, strong)
    return gr.reachable(strong, k.sat("signup").select(F.col("state").alias("node")))


@query("scc", f"WITH RECURSIVE {KRIPKE}, {_CLOSURE}, nodes AS (SELECT src AS node FROM strong UNION SELECT dst FROM strong) SELECT node, coalesce((SELECT min(a.y) FROM clo a JOIN clo b ON a.x = b.y AND a.y = b.x WHERE a.x = node), node) AS component FROM nodes")
def _(spark, sf_dir):
    return gr.strong_components(_strong(spark, sf_dir))


@query("induced_subgraph", f"WITH {KRIPKE}, n AS (SELECT state FROM labels WHERE ap IN ('view', 'click')) SELECT src, dst FROM strong WHERE src IN (FROM n) AND dst IN (FROM n)")
def _(spark, sf_dir):
    strong = _strong(spark, sf_dir)
    k = _kripke(spark, sf_dir, strong)
    return gr.induced(strong, k.sat(("or", "view", "click")).select(F.col("state").alias("node")))


@query("reversed_graph", f"WITH {KRIPKE} SELECT dst AS src, src AS dst FROM strong")
def _(spark, sf_dir):
    return gr.reversed_graph(_strong(spark, sf_dir))


@query("graph_sources", f"WITH {KRIPKE} SELECT DISTINCT src AS node FROM strong")
def _(spark, sf_dir):
    return gr.sources(_strong(spark, sf_dir))


# ---- transition systems of the learned networks: every edge with all pairs of values, nothing dropped

NET = f"""{LEARN}, iv AS (SELECT model_id, signal, outcome, row_number() OVER (PARTITION BY model_id, signal ORDER BY outcome) - 1 AS i FROM val),
ns AS (SELECT x.model_id, x.vertex, x.model_id || '/' || x.vertex || ':' || iv.i AS state, x.signal || ':' || iv.outcome AS ap FROM vert x JOIN iv ON iv.model_id = x.model_id AND iv.signal = x.signal
  UNION ALL SELECT m, b, m || '/' || b || ':0', b || ':0' FROM (SELECT DISTINCT model_id AS m FROM vert) x, (SELECT unnest(['start', 'terminal']) AS b) y),
ne AS (SELECT model_id, signal || '_' || (k - 1) AS a, vertex AS b FROM vert WHERE k > 0 UNION ALL SELECT model_id, 'E_' || (k - 1), vertex FROM vert WHERE k > 0 AND signal = 'V'
  UNION ALL SELECT model_id, 'start', vertex FROM vert WHERE k = 0 UNION ALL SELECT model_id, vertex, 'terminal' FROM vert WHERE k = {LENGTH - 1}
  UNION ALL SELECT DISTINCT model_id, 'terminal', 'terminal' FROM vert),
states AS (SELECT state FROM ns), labels AS (SELECT state, ap FROM ns),
trans AS (SELECT x.state AS src, y.state AS dst FROM ne JOIN ns x ON x.model_id = ne.model_id AND x.vertex = ne.a JOIN ns y ON y.model_id = ne.model_id AND y.vertex = ne.b)"""


def _network_kripke(spark, sf_dir):
    v = checkpointed(nw.vertices(checkpointed(counts(spark, sf_dir))))
    return lg.of_network(v, nw.edges(v).union(nw.boundary_edges(v))).checked()


@query("network_kripke_transitions", f"WITH {NET} SELECT src, dst FROM trans")
def _(spark, sf_dir):
    return _network_kripke(spark, sf_dir).transitions


@query("network_kripke_labels", f"WITH {NET} SELECT state, ap FROM labels")
def _(spark, sf_dir):
    return _network_kripke(spark, sf_dir).labels


_BUY, _ERR, _HI, _LO = "E:purchase", "E:error", "V:hi", "V:lo"
NETWORK_FORMULAS = {
    "ap": _BUY, "not": ("not", _BUY), "or": ("or", _BUY, _HI), "and": ("and", _BUY, ("EX", _HI)), "imply": ("imply", _BUY, ("EX", _HI)),
    "ex": ("EX", _BUY), "ax": ("AX", ("or", _HI, _LO)), "ef": ("EF", _ERR), "af": ("AF", ("or", _HI, _LO)), "eg": ("EG", ("not", _ERR)), "ag": ("AG", ("not", _ERR)),
    "eu": ("EU", ("not", _ERR), _BUY), "au": ("AU", ("not", _ERR), "terminal:0"), "er": ("ER", _HI, ("not", _ERR)), "ar": ("AR", _BUY, ("not", _ERR)), "ew": ("EW", ("not", _ERR), _BUY), "aw": ("AW", ("or", _HI, _LO), "terminal:0"),
    "option": ("EU", "E:view", ("and", "E:click", ("EX", _BUY))),
}
for _name, _formula in NETWORK_FORMULAS.items():

    @query(f"network_ctl_{_name}", f"WITH {NET} SELECT state FROM ({_sat_sql(_formula)})")
    def _(spark, sf_dir, formula=_formula):
        return _network_kripke(spark, sf_dir).sat(formula)


_NET_CLOSURE = "clo AS (SELECT src AS x, dst AS y FROM trans UNION SELECT clo.x, t.dst FROM clo JOIN trans t ON t.src = clo.y)"


@query("network_ctl_fair", f"WITH RECURSIVE {NET}, {_NET_CLOSURE}, good AS (SELECT DISTINCT a.x FROM clo a JOIN clo b ON a.x = b.y AND a.y = b.x JOIN labels l ON l.state = a.y AND l.ap = 'terminal:0') SELECT x AS state FROM good UNION SELECT x FROM clo WHERE y IN (SELECT x FROM good)")
def _(spark, sf_dir):
    return _network_kripke(spark, sf_dir).fair_states(["terminal:0"])


@query("network_reachable_set", f"WITH RECURSIVE {NET}, r AS (SELECT state AS node FROM labels WHERE ap = 'E:signup' UNION SELECT t.dst FROM r JOIN trans t ON t.src = r.node) SELECT node FROM r")
def _(spark, sf_dir):
    k = _network_kripke(spark, sf_dir)
    return gr.reachable(k.transitions, k.sat("E:signup").select(F.col("state").alias("node")))


@query("network_scc", f"WITH RECURSIVE {NET}, {_NET_CLOSURE} SELECT state AS node, coalesce((SELECT min(a.y) FROM clo a JOIN clo b ON a.x = b.y AND a.y = b.x WHERE a.x = state), state) AS component FROM states")
def _(spark, sf_dir):
    return gr.strong_components(_network_kripke(spark, sf_dir).transitions)


@query("network_induced_subgraph", f"WITH {NET}, n AS (SELECT state FROM labels WHERE ap IN ('E:view', 'E:click')) SELECT src, dst FROM trans WHERE src IN (FROM n) AND dst IN (FROM n)")
def _(spark, sf_dir):
    k = _network_kripke(spark, sf_dir)
    return gr.induced(k.transitions, k.sat(("or", "E:view", "E:click")).select(F.col("state").alias("node")))


@query("network_reversed_graph", f"WITH {NET} SELECT dst AS src, src AS dst FROM trans")
def _(spark, sf_dir):
    return gr.reversed_graph(_network_kripke(spark, sf_dir).transitions)


@query("network_graph_sources", f"WITH {NET} SELECT DISTINCT src AS node FROM trans")
def _(spark, sf_dir):
    return gr.sources(_network_kripke(spark, sf_dir).transitions)


# ---- boolean functions

_TRUTH = f"""tt AS (SELECT a, b, c, count(e.event_id) AS n FROM (SELECT unnest([false, true]) AS a) JOIN (SELECT unnest([false, true]) AS b) ON true JOIN (SELECT unnest([false, true]) AS c) ON true
  LEFT JOIN events e ON (e.value >= {CUT}) = a AND (e.event_type = 'purchase') = b AND (hour(e.ts) < 12) = c GROUP BY ALL),
f AS (SELECT a, b, c, n % 2 = 0 AS f FROM tt), g AS (SELECT b, c, sum(n) % 3 = 0 AS f FROM tt GROUP BY ALL)"""


def _truth(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("value") >= CUT).alias("a"), (F.col("event_type") == "purchase").alias("b"), (F.hour("ts") < 12).alias("c"))
    both = F.array(F.lit(False), F.lit(True))
    n = e.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    grid = spark.range(1).select(F.explode(both).alias("a")).select("a", F.explode(both).alias("b")).select("a", "b", F.explode(both).alias("c"))
    n = checkpointed(grid.join(n, ["a", "b", "c"], "left").fillna(0, ["n"]))
    f = n.select("a", "b", "c", (F.col("n") % 2 == 0).alias("f"))
    g = n.groupBy("b", "c").agg((F.sum("n") % 3 == 0).alias("f"))
    return f, g


for _op, _sql in (("and", "f.f AND g.f"), ("or", "f.f OR g.f"), ("xor", "f.f <> g.f")):

    @query(f"boolfn_{_op}", f"WITH {_TRUTH} SELECT a, b, c, {_sql} AS f FROM f JOIN g USING (b, c)")
    def _(spark, sf_dir, op=_op):
        return bf.apply(*_truth(spark, sf_dir), op)


@query("boolfn_negate", f"WITH {_TRUTH} SELECT a, b, c, NOT f AS f FROM f")
def _(spark, sf_dir):
    return bf.negated(_truth(spark, sf_dir)[0])


@query("boolfn_restrict", f"WITH {_TRUTH} SELECT a, c, f FROM f WHERE b")
def _(spark, sf_dir):
    return bf.restricted(_truth(spark, sf_dir)[0], "b", True)


@query("boolfn_essential", f"WITH {_TRUTH}, e AS (SELECT 'a' AS variable FROM f GROUP BY b, c HAVING min(f) <> max(f) UNION SELECT 'b' FROM f GROUP BY a, c HAVING min(f) <> max(f) UNION SELECT 'c' FROM f GROUP BY a, b HAVING min(f) <> max(f)) SELECT variable FROM e")
def _(spark, sf_dir):
    return bf.essential(_truth(spark, sf_dir)[0])


@query("boolfn_equivalent", f"WITH {_TRUTH} SELECT count(*) = 0 AS equivalent FROM f JOIN g USING (b, c) WHERE (f.f OR g.f) <> (NOT (NOT f.f AND NOT g.f))")
def _(spark, sf_dir):
    f, g = _truth(spark, sf_dir)
    return bf.equivalent(bf.apply(f, g, "or"), bf.negated(bf.apply(bf.negated(f), bf.negated(g), "and")))


# ---- sampling

_U = "('0x' || substr(md5(concat_ws('|', '0', sample_key, '{v}')), 1, 8))::BIGINT / 4294967296.0"
_ORDER = [(f"{s}_{k}", [] if k == 0 else [f"E_{k - 1}"] if s == "E" else [f"V_{k - 1}", f"E_{k - 1}"]) for k in range(LENGTH) for s in "EV"]
_DRAWS = ["d0 AS (SELECT DISTINCT model_id, user_id || '/' || s AS sample_key FROM slot)"]
for _i, (_v, _pa) in enumerate(_ORDER):
    _pv = "[]::VARCHAR[]" if not _pa else "[" + ", ".join(f'"{x}"' for x in _pa) + "]"
    _DRAWS.append(f'd{_i + 1} AS (SELECT d.*, CASE WHEN len(list_filter(cdf, lambda x: x.c > {_U.format(v=_v)})) > 0 THEN list_filter(cdf, lambda x: x.c > {_U.format(v=_v)})[1].o ELSE cdf[-1].o END AS "{_v}" FROM d{_i} d JOIN cdf ON cdf.model_id = d.model_id AND cdf.vertex = \'{_v}\' AND cdf.pv = {_pv})')
_CDF = "cum AS (SELECT *, sum(p) OVER (PARTITION BY model_id, vertex, pv ORDER BY outcome) AS c FROM cpt), cdf AS (SELECT model_id, vertex, pv, list({'c': c, 'o': outcome} ORDER BY outcome) AS cdf FROM cum GROUP BY ALL)"


@query("ancestral_sample", f"WITH {LEARN}, {_CDF}, {', '.join(_DRAWS)} SELECT * FROM d{len(_ORDER)}")
def _(spark, sf_dir):
    run = tr.samples(placed(spark, sf_dir), LENGTH)
    ids = run.select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(MODELS)).cast("string")).alias("model_id"), F.concat_ws("/", "user_id", "sample").alias("sample_key"))
    return sm.ancestral(checkpointed(cpt(spark, sf_dir)), ids, _ORDER)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns the networks of ``events``, finds their state paths above the threshold, and mines specifications that hold in the networks without some edges."""
    return QUERIES["cb_specs"](spark, sf_dir)


@query("pattern_merge")
def _(spark, sf_dir):
    """Accepted paths merged with the others by distance until the acceptance rules end it; depends on order, so there is no SQL (tests compare worked cases)."""
    networks = _learned(spark, sf_dir)
    return mining.patterns_of_paths(checkpointed(mining.flagged(_numbered(spark, sf_dir, networks), patterns.edge_flags(networks[1]))))


@query("stream_window_counts", "WITH h AS (SELECT date_trunc('hour', ts) AS w, event_type, ts FROM events) SELECT w AS \"start\", event_type, count(*) AS n FROM h WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY w, event_type")
def _(spark, sf_dir):
    counted = windows.run_to_end(windows.window_counts(windows.event_stream(spark, sf_dir)), work_path(spark))
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


from . import catalog_diagrams, catalog_interleaved, catalog_mining, catalog_temporal  # noqa: E402, F401  register their queries
