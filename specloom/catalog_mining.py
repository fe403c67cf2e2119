"""Registered queries of the miners, of linear-time and fair model checking, and of further changes to networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as c
from .operators import boolfn as bf
from .operators import linear, patterns
from .operators import network as nw
from .operators import sampling as sm
from .operators import traces as tr
from .plans import mining
from .sources.tables import checkpointed, node_data, ordered_skeleton, read, read_model_files, skeleton, work_path, write_model_files, write_specs

query, LEARN, LENGTH, MODELS, CUT = c.query, c.LEARN, c.LENGTH, c.MODELS, c.CUT
REMOVED = 0.25

# ---- changes to networks

_ROWS = "SELECT model_id, vertex, array_to_string(pv, ',') AS parent_vals, outcome"


def _removal_sql(most: str) -> str:
    return (
        f"WITH {LEARN}, cross_ AS (SELECT model_id, vertex, row_number() OVER (PARTITION BY model_id ORDER BY md5(concat_ws('|', model_id, 'E_' || (k - 1), vertex))) AS place, count(*) OVER (PARTITION BY model_id) AS n FROM vert WHERE signal = 'V' AND k > 0),"
        f" gone AS (SELECT model_id, vertex FROM cross_ WHERE place <= {most}),"
        " a AS (SELECT t.model_id, t.vertex, CASE WHEN g.vertex IS NULL THEN t.pv ELSE t.pv[1:1] END AS pv, t.outcome, avg(t.p) AS p FROM cpt t LEFT JOIN gone g ON g.model_id = t.model_id AND g.vertex = t.vertex GROUP BY ALL)"
        f" {_ROWS}, round(p / sum(p) OVER (PARTITION BY model_id, vertex, pv), 9) AS p FROM a"
    )


@query("edge_removal_number", _removal_sql("2"))
def _(spark, sf_dir):
    t = c.cpt(spark, sf_dir)
    e = nw.cross_edges(nw.edges(t.select("model_id", "vertex", "parents").distinct()))
    return c.cpt_rows(nw.without_edges(t, nw.chosen_edges(e, number=2)))


@query("edge_removal_share", _removal_sql("round_even(n * 0.6, 0)"))
def _(spark, sf_dir):
    t = c.cpt(spark, sf_dir)
    e = nw.cross_edges(nw.edges(t.select("model_id", "vertex", "parents").distinct()))
    return c.cpt_rows(nw.without_edges(t, nw.chosen_edges(e, share=0.6)))


@query("clear_parameters", f"WITH {LEARN} {_ROWS}, 0.0::DOUBLE AS p FROM cpt")
def _(spark, sf_dir):
    return c.cpt_rows(nw.cleared(c.cpt(spark, sf_dir)))


@query(
    "network_neighbours",
    f"{c._CHAIN}, e AS (SELECT model_id, s || '_' || k AS src, s || '_' || (k + 1) AS dst FROM m, s, k WHERE k < {LENGTH - 1} UNION ALL SELECT model_id, 'E_' || k, 'V_' || (k + 1) FROM m, k WHERE k < {LENGTH - 1})"
    " SELECT model_id, s || '_' || k AS vertex, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE e.model_id = m.model_id AND dst = s || '_' || k), '') AS parents, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE e.model_id = m.model_id AND src = s || '_' || k), '') AS children FROM m, s, k",
)
def _(spark, sf_dir):
    v = checkpointed(nw.vertices(c.counts(spark, sf_dir)))
    n = nw.neighbours(nw.with_edges(nw.edges(v).where("src LIKE 'E%'"), nw.edges(v).where("src LIKE 'V%'")))
    return n.select("model_id", "vertex", c.joined("parents"), c.joined("children"))


@query("structural_boundary", f"{c._CHAIN} SELECT model_id, 'start' AS src, s || '_0' AS dst FROM m, s UNION ALL SELECT model_id, s || '_{LENGTH - 1}', 'terminal' FROM m, s")
def _(spark, sf_dir):
    v = checkpointed(nw.vertices(c.counts(spark, sf_dir)))
    return nw.structural_boundary(nw.edges(v), v.select("model_id", "vertex"))


_GAPS = f"{c._CHAIN}, e AS (SELECT model_id, s || '_' || k AS src, s || '_' || (k + 1) AS dst FROM m, s, k WHERE k < {LENGTH - 1} UNION ALL SELECT model_id, 'E_' || k, 'V_' || (k + 1) FROM m, k WHERE k < {LENGTH - 1})"


@query("gap_edges", f"{_GAPS} SELECT * FROM e UNION ALL SELECT model_id, src, 'dL_' || dst FROM e UNION ALL SELECT DISTINCT model_id, dst, 'dL_' || dst FROM e")
def _(spark, sf_dir):
    return nw.with_gaps(nw.edges(nw.vertices(c.counts(spark, sf_dir))))


@query("value_edges", f"{_GAPS} SELECT * FROM e")
def _(spark, sf_dir):
    return nw.without_gaps(nw.with_gaps(nw.edges(nw.vertices(c.counts(spark, sf_dir)))))


@query(
    "reachable_without_removed",
    f"WITH RECURSIVE {LEARN}, {c.MARGINALS}, stay AS (SELECT DISTINCT model_id, signal || '_' || k AS vertex FROM marg WHERE p >= 0.22), ed AS (SELECT model_id, signal || '_' || (k - 1) AS src, vertex AS dst FROM vert WHERE k > 0 UNION SELECT model_id, 'E_' || (k - 1), vertex FROM vert WHERE k > 0 AND signal = 'V'),"
    " r AS (SELECT DISTINCT model_id, 'E_0' AS vertex FROM vert UNION SELECT r.model_id, ed.dst FROM r JOIN ed ON ed.model_id = r.model_id AND ed.src = r.vertex JOIN stay ON stay.model_id = ed.model_id AND stay.vertex = ed.dst) SELECT model_id, vertex FROM r",
)
def _(spark, sf_dir):
    """What the first event leads to, leaving out values with less than 22 %."""
    t, v = c._learned(spark, sf_dir)
    m = nw.marginals(t, LENGTH)
    seeds = v.where("vertex = 'E_0'").select("model_id", "vertex")
    return nw.reachable_states(nw.edges(v), v, seeds, m.where("p < 0.22").select("model_id", "vertex", "outcome"))


@query("invariant_false_positives_first", f"WITH {c.FOUND} SELECT kind, count(*) AS n, count(*) FILTER (CASE kind WHEN 'not_followed' THEN substr(a, 1, 1) <> substr(a, 2, 1) ELSE substr(a, 1, 2) <> substr(b, 1, 2) END) AS n_false FROM found GROUP BY kind")
def _(spark, sf_dir):
    return tr.false_positives(c._found(spark, sf_dir), first_only=True)


# ---- sampling

_EVIDENCE = {"V_1": "hi"}


def _draws(evidence: dict[str, str]) -> list[str]:
    rows = ["d0 AS (SELECT DISTINCT model_id, user_id || '/' || s AS sample_key FROM slot)"]
    for i, (v, pa) in enumerate(c._ORDER):
        pv = "[]::VARCHAR[]" if not pa else "[" + ", ".join(f'"{x}"' for x in pa) + "]"
        u = c._U.format(v=v)
        drawn = f"coalesce(list_filter(cdf, lambda x: x.c > {u})[1].o, cdf[-1].o)"
        rows.append(f"d{i + 1} AS (SELECT *, '{evidence[v]}' AS \"{v}\" FROM d{i})" if v in evidence else f"d{i + 1} AS (SELECT d.*, {drawn} AS \"{v}\" FROM d{i} d JOIN cdf ON cdf.model_id = d.model_id AND cdf.vertex = '{v}' AND cdf.pv = {pv})")
    return rows


@query("ancestral_sample_evidence", f"WITH {LEARN}, {c._CDF}, {', '.join(_draws(_EVIDENCE))} SELECT * FROM d{len(c._ORDER)}")
def _(spark, sf_dir):
    run = tr.samples(c.placed(spark, sf_dir), LENGTH)
    ids = run.select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(MODELS)).cast("string")).alias("model_id"), F.concat_ws("/", "user_id", "sample").alias("sample_key"))
    return sm.ancestral(checkpointed(c.cpt(spark, sf_dir)), ids, c._ORDER, evidence=_EVIDENCE)


_HASHED = "('0x' || substr(md5(concat_ws('|', 'gap', event_id::VARCHAR, '{}')), 1, 8))::BIGINT / 4294967296.0"


@query(
    "gaussian_gaps",
    f"WITH {c.SEQ}, g AS (SELECT a.event_id, a.event_type, a.value, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.pos = a.pos + 1),"
    " n AS (SELECT event_type, avg(gap) AS mean, var_pop(gap) AS variance FROM g GROUP BY event_type)"
    f" SELECT event_id, round(mean + 0.5 * value + sqrt(variance) * sqrt(-2 * ln(1 - {_HASHED.format('u')})) * cos(2 * pi() * {_HASHED.format('v')}), 3) AS gap FROM g JOIN n USING (event_type)",
)
def _(spark, sf_dir):
    """Gaps to the next event as a linear Gaussian node: one normal for each event type, shifted by half the event's value, drawn for every event."""
    p = c.placed(spark, sf_dir)
    nxt = p.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("ts").alias("later"))
    micros = lambda n: F.unix_micros(F.col(n).cast("timestamp"))
    g = checkpointed(p.join(nxt, ["user_id", "pos"]).select("event_id", "event_type", "value", ((micros("later") - micros("ts")) / 1e6).alias("gap")))
    n = g.groupBy("event_type").agg(F.avg("gap").alias("mean"), F.var_pop("gap").alias("variance"))
    z = sm.normal(F.lit("gap"), F.col("event_id").cast("string"))
    return g.join(n, "event_type").select("event_id", F.round(sm.gaussian(F.col("mean"), F.col("variance"), z, [(F.lit(0.5), F.col("value"))]), 3).alias("gap"))


@query("gibbs_sample")
def _(spark, sf_dir):
    """A chain for each sample after two sweeps given V_2 = hi (tests compare with a plain loop)."""
    run = tr.samples(c.placed(spark, sf_dir), LENGTH)
    ids = run.select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(MODELS)).cast("string")).alias("model_id"), F.concat_ws("/", "user_id", "sample").alias("sample_key"))
    return sm.gibbs(checkpointed(c.cpt(spark, sf_dir)), ids, c._ORDER, 2, {"V_2": "hi"})


# ---- model files


def _files(spark, sf_dir):
    path = work_path(spark)
    write_model_files(checkpointed(nw.vertices(c.counts(spark, sf_dir))), path)
    return read_model_files(spark, path)


_SKELETON = f"{c._CHAIN}, e AS (SELECT model_id, s || '_' || k AS src, s || '_' || (k + 1) AS dst FROM m, s, k WHERE k < {LENGTH - 1} UNION ALL SELECT model_id, 'E_' || k, 'V_' || (k + 1) FROM m, k WHERE k < {LENGTH - 1})"


@query("model_file_edges", f"{_SKELETON} SELECT model_id, (row_number() OVER (PARTITION BY model_id ORDER BY src, dst) - 1)::INT AS ord, src, dst FROM e")
def _(spark, sf_dir):
    return skeleton(_files(spark, sf_dir))[1]


@query("model_file_order", f"{_SKELETON} SELECT model_id, s || '_' || k AS vertex, k AS depth, (row_number() OVER (PARTITION BY model_id ORDER BY k, s) - 1)::INT AS place FROM m, s, k")
def _(spark, sf_dir):
    return ordered_skeleton(_files(spark, sf_dir), LENGTH)


@query("model_file_nodes", f"WITH {LEARN}, o AS (SELECT model_id, signal, string_agg(outcome, ',' ORDER BY outcome) AS vals FROM val GROUP BY ALL) SELECT v.model_id, v.vertex, o.vals, CASE WHEN k = 0 THEN '' WHEN v.signal = 'E' THEN 'E_' || (k - 1) ELSE 'V_' || (k - 1) || ',E_' || (k - 1) END AS parents FROM vert v JOIN o ON o.model_id = v.model_id AND o.signal = v.signal")
def _(spark, sf_dir):
    return node_data(_files(spark, sf_dir)).select("model_id", "vertex", c.joined("vals"), c.joined("parents"))


# ---- an irregular graph: steps between event types that are likely enough


_STEPS = f"st AS (SELECT model_id, a.e || '_' || a.k AS src, b.e || '_' || b.k AS dst, count(*) AS n FROM (SELECT * FROM slot) a JOIN slot b USING (model_id, user_id, s) WHERE b.k = a.k + 1 GROUP BY ALL), step AS (SELECT model_id, src, dst FROM (SELECT *, sum(n) OVER (PARTITION BY model_id, src) AS total FROM st) WHERE n >= 0.22 * total)"


def _steps(spark, sf_dir):
    model = F.concat(F.lit("m"), F.pmod("user_id", F.lit(MODELS)).cast("string"))
    e = F.col("events.event_type")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 2)), lambda k: F.struct(F.concat_ws("_", e[k], k).alias("src"), F.concat_ws("_", e[k + 1], k + 1).alias("dst"))))
    n = tr.samples(c.placed(spark, sf_dir), LENGTH).select(model.alias("model_id"), pairs.alias("x")).groupBy("model_id", "x.src", "x.dst").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model_id", "src"))
    return checkpointed(n.withColumn("total", total).where("n >= 0.22 * total").select("model_id", "src", "dst"))


@query("step_depth", f"WITH RECURSIVE {c.SEQ}, {c.SLOT}, {_STEPS}, v AS (SELECT model_id, src AS vertex FROM step UNION SELECT model_id, dst FROM step), w AS (SELECT model_id, vertex, 0 AS d FROM v UNION SELECT w.model_id, step.dst, d + 1 FROM w JOIN step ON step.model_id = w.model_id AND step.src = w.vertex) SELECT model_id, vertex, max(d)::INT AS depth FROM w GROUP BY ALL")
def _(spark, sf_dir):
    e = _steps(spark, sf_dir)
    v = e.select("model_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    return nw.depths(e, v, LENGTH)


@query("step_boundary", f"WITH {c.SEQ}, {c.SLOT}, {_STEPS} SELECT DISTINCT model_id, 'start' AS src, src AS dst FROM step a WHERE NOT EXISTS (SELECT 1 FROM step b WHERE b.model_id = a.model_id AND b.dst = a.src) UNION ALL SELECT DISTINCT model_id, dst, 'terminal' FROM step a WHERE NOT EXISTS (SELECT 1 FROM step b WHERE b.model_id = a.model_id AND b.src = a.dst)")
def _(spark, sf_dir):
    e = _steps(spark, sf_dir)
    return nw.structural_boundary(e, e.select("model_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct())


@query("step_cross_edges", f"WITH {c.SEQ}, {c.SLOT}, {_STEPS} SELECT * FROM step WHERE string_split(src, '_')[1] <> string_split(dst, '_')[1]")
def _(spark, sf_dir):
    return nw.cross_edges(_steps(spark, sf_dir))


# ---- which edges may be the very next

_CODE = "('0x' || substr(md5(concat_ws('|', 'xable', model_id, vertex)), {}, 8))::BIGINT"


@query(
    "next_flags",
    f"WITH {c.SEQ}, {c.SLOT}, {c.OBS}, vert AS (SELECT DISTINCT model_id, vertex, signal, k FROM obs WHERE k > 0), ch AS (SELECT *, CASE WHEN {_CODE.format(1)} / 4294967296 < 0.7 THEN {_CODE.format(9)} % (CASE signal WHEN 'V' THEN 2 ELSE 1 END) ELSE -1 END AS chosen FROM vert)"
    " SELECT model_id, signal || '_' || (k - 1) AS src, vertex AS dst, chosen = 0 AS xable FROM ch UNION ALL SELECT model_id, 'E_' || (k - 1), vertex, chosen = 1 FROM ch WHERE signal = 'V'",
)
def _(spark, sf_dir):
    return patterns.edge_flags(nw.vertices(c.counts(spark, sf_dir)))


# ---- traces of tokens

_TRACES = f"""{c.SEQ}, s AS (SELECT user_id, pos // {LENGTH} AS sample, pos // {LENGTH} // 3 AS trace, pos % {LENGTH} AS i, event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS t FROM seq WINDOW w AS (PARTITION BY user_id, pos // {LENGTH}) QUALIFY count(*) OVER w = {LENGTH}),
ends AS (SELECT user_id, trace, sample, max(t) AS last FROM s GROUP BY ALL), shifts AS (SELECT user_id, trace, sample, coalesce(sum(last + 0.1) OVER (PARTITION BY user_id, trace ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, count(*) OVER (PARTITION BY user_id, trace) AS n FROM ends),
tt AS (SELECT s.user_id, s.trace, s.sample, s.i, 'F' || (s.user_id % 2) || '.E=' || event_type AS token, shift + t AS t FROM s JOIN shifts USING (user_id, trace, sample) WHERE n = 3)"""


def _token_traces(spark, sf_dir):
    return tr.token_traces(tr.samples(c.placed(spark, sf_dir), LENGTH), 3, F.pmod("user_id", F.lit(2)))


@query("token_traces", f"WITH {_TRACES} SELECT user_id, trace, sample, token, round(t, 3) AS t FROM tt")
def _(spark, sf_dir):
    return _token_traces(spark, sf_dir).select("user_id", "trace", "sample", "token", F.round("t", 3).alias("t"))


@query("merged_logs", f"WITH {_TRACES} SELECT user_id // 2 AS pair, trace, (row_number() OVER (PARTITION BY user_id // 2, trace ORDER BY round(t, 6), token, sample, i) - 1)::INT AS pos, token FROM tt")
def _(spark, sf_dir):
    """Whole traces of two users each, one of either origin, merged by time."""
    t = _token_traces(spark, sf_dir).withColumn("pair", F.floor(F.col("user_id") / 2)).withColumn("t", F.round("t", 6))
    return tr.merged_logs(t, ["pair", "trace"]).select("pair", "trace", "pos", "token")


# ---- boolean functions from text


@query("boolfn_parsed", f"SELECT event_type, count(*) FILTER ((a AND NOT b) OR (b <> c)) AS n_true, count(*) AS n FROM (SELECT event_type, value >= {CUT} AS a, event_type = 'purchase' AS b, hour(ts) < 12 AS c FROM events) GROUP BY event_type")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", (F.col("value") >= CUT).alias("a"), (F.col("event_type") == "purchase").alias("b"), (F.hour("ts") < 12).alias("c"))
    _, f = bf.parsed("lambda a, b, c: (a & ~b) | (b ^ c)")
    return e.groupBy("event_type").agg(F.count(F.when(f, 1)).alias("n_true"), F.count("*").alias("n"))


# ---- fair and collapsed variants, linear time, CTL*

_INNER = "SELECT src AS x, dst AS y FROM trans WHERE src NOT IN (SELECT state FROM labels WHERE ap = 'error') AND dst NOT IN (SELECT state FROM labels WHERE ap = 'error')"


@query(
    "ctl_eg_under_fairness",
    f"WITH RECURSIVE {c.KRIPKE}, c AS ({_INNER} UNION SELECT c.x, i.y FROM c JOIN ({_INNER}) i ON i.x = c.y),"
    " good AS (SELECT DISTINCT p.x FROM c p JOIN c q ON p.x = q.y AND p.y = q.x JOIN labels l ON l.state = p.y AND l.ap = 'purchase') SELECT x AS state FROM good UNION SELECT x FROM c WHERE y IN (SELECT x FROM good)",
)
def _(spark, sf_dir):
    return c._kripke(spark, sf_dir).under(["purchase"]).sat(("EG", ("not", "error")))


@query(
    "ctl_eu_collapsed",
    f"WITH RECURSIVE {c.KRIPKE}, p AS (SELECT state FROM labels WHERE ap = 'view'), q AS (SELECT state FROM labels WHERE ap = 'purchase'),"
    " known AS (SELECT src AS state FROM trans WHERE src IN (FROM p) AND dst IN (FROM p) UNION SELECT dst FROM trans WHERE src IN (FROM p)),"
    " r AS (SELECT state FROM q UNION SELECT t.src FROM r JOIN trans t ON t.dst = r.state WHERE t.src IN (FROM p))"
    " SELECT state FROM r WHERE NOT EXISTS (SELECT 1 FROM q WHERE state NOT IN (FROM known)) OR state IN (FROM q)",
)
def _(spark, sf_dir):
    k = c._kripke(spark, sf_dir)
    k.collapsed = True
    return k.sat(("EU", "view", "purchase"))


_BUY, _ERR, _HI, _LO = "E:purchase", "E:error", "V:hi", "V:lo"
#: A CTL* formula, and the branching-time formula that its SQL is made of: they have the same states.
LINEAR = {
    "future": (("A", ("F", ("or", _HI, _LO))), ("AF", ("or", _HI, _LO))),
    "response": (("A", ("G", ("imply", _HI, ("F", _LO)))), ("AG", ("imply", _HI, ("AF", _LO)))),
    "next": (("A", ("X", ("or", _HI, _LO))), ("AX", ("or", _HI, _LO))),
    "until": (("A", ("U", ("not", _ERR), "terminal:0")), ("AU", ("not", _ERR), "terminal:0")),
    "release": (("A", ("R", _BUY, ("not", _ERR))), ("AR", _BUY, ("not", _ERR))),
    "weak_until": (("E", ("W", ("not", _ERR), _BUY)), ("EW", ("not", _ERR), _BUY)),
    "both": (("E", ("and", ("F", _BUY), ("F", _ERR))), ("or", ("EF", ("and", _BUY, ("EF", _ERR))), ("EF", ("and", _ERR, ("EF", _BUY))))),
    "nested": (("E", ("F", ("and", _BUY, ("A", ("G", ("not", _ERR)))))), ("EF", ("and", _BUY, ("AG", ("not", _ERR))))),
}
for _name, (_formula, _same) in LINEAR.items():

    @query(f"network_{'ctlstar' if _name == 'nested' else 'ltl'}_{_name}", f"WITH {c.NET} SELECT state FROM ({c._sat_sql(_same)})")
    def _(spark, sf_dir, formula=_formula):
        return linear.check(c._network_kripke(spark, sf_dir), formula)


# ---- patterns


@query(
    "pattern_metrics",
    f"WITH {c.SEQ}, s AS (SELECT user_id, pos // {LENGTH} // 3 AS run, pos % {LENGTH} AS k, event_type FROM seq QUALIFY count(*) OVER (PARTITION BY user_id, pos // {LENGTH}) = {LENGTH}),"
    " sym AS (SELECT user_id, run, k, count(DISTINCT event_type) AS n FROM s GROUP BY ALL), ends AS (SELECT user_id, run, min(k) FILTER (n < 3) AS a, max(k) FILTER (n < 3) AS z FROM sym GROUP BY ALL),"
    " m AS (SELECT user_id, run, count(*) FILTER (k BETWEEN a AND z) AS len, count(*) FILTER (k BETWEEN a AND z AND n = 1) AS one, product(CASE WHEN k BETWEEN a AND z THEN CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END ELSE 1 END) AS strings FROM sym JOIN ends USING (user_id, run) GROUP BY ALL),"
    " f AS (SELECT user_id, run, CASE WHEN len >= 2 THEN len ELSE 0 END AS length, CASE WHEN len >= 2 THEN one ELSE 0 END AS letters, CASE WHEN len >= 2 THEN one / len ELSE 0 END AS ratio, CASE WHEN len >= 2 THEN strings ELSE 0 END AS strings FROM m)"
    " SELECT user_id, run, length::INT AS length, letters::INT AS letters, round(ratio, 9) AS ratio, strings::BIGINT AS strings, ratio >= 0.5 AND strings <= pow(2.5, length // 2) AS compared,"
    " CASE WHEN ratio < 0.5 OR strings > pow(2, length // 2) THEN -1 WHEN ratio > 0.8 OR strings < pow(2, length // 5 + 1) THEN 0 ELSE 1 END::INT AS by_metric FROM f",
)
def _(spark, sf_dir):
    """Three samples of a user as one pattern, place by place: one event type is a letter, two are a group, three an option."""
    s = tr.samples(c.placed(spark, sf_dir), LENGTH).select("user_id", F.floor(F.col("sample") / 3).cast("long").alias("run"), F.posexplode("events.event_type").alias("k", "t"))
    s = s.groupBy("user_id", "run", "k").agg(F.array_sort(F.collect_set("t")).alias("tokens"))
    kind = F.when(F.size("tokens") == 1, patterns.LETTER).when(F.size("tokens") == 2, patterns.GROUP).otherwise(patterns.OPTION)
    s = s.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("k", "tokens", kind.alias("kind"), F.lit(False).alias("xable")))).alias("symbols"))
    return patterns.metrics(s).select("user_id", "run", "length", "letters", *c.rounded("ratio"), "strings", "compared", "by_metric")


# ---- miners


def _mined(spark: SparkSession, sf_dir: str, thetas: tuple[float, ...] = (c.THETA,), shares: tuple[float, ...] = (REMOVED,)) -> tuple[DataFrame, DataFrame]:
    """Attempts of every network and threshold (model_id: network@theta), and for each share of removed cross edges the networks that judge them
    (model_id: network@theta/share), in one job. Paths above the lowest threshold are found once and filtered for the others."""
    networks = c._learned(spark, sf_dir)
    return _mined_of(networks, c._numbered(spark, sf_dir, networks), LENGTH, thetas, shares)


def _mined_of(networks: tuple[DataFrame, DataFrame], numbered: DataFrame, length: int, thetas: tuple[float, ...] = (c.THETA,), shares: tuple[float, ...] = (REMOVED,)) -> tuple[DataFrame, DataFrame]:
    """The same for networks (cpt, vertices) with up to ``length`` places a signal, and their numbered paths."""
    t, v = networks
    paths = mining.flagged(numbered, patterns.edge_flags(v))
    at = lambda x: F.format_string("%s@%.2f", "model_id", x)
    each = paths.withColumn("theta", F.explode(F.array(*map(F.lit, thetas)))).where("metric <= 1 - theta")
    found = mining.attempts(checkpointed(each.withColumn("model_id", at("theta")).drop("nodes")))
    found = checkpointed(found.withColumn("theta", F.element_at(F.split("model_id", "@"), 2).cast("double")))
    cross = nw.cross_edges(nw.edges(v))
    of = lambda x: F.format_string("%s/%.2f", "model_id", x)
    gone = reduce(DataFrame.union, [nw.chosen_edges(cross, share=x).withColumn("model_id", of(F.lit(x))) for x in shares])
    every = lambda df: df.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("model_id", of(F.col("share"))).drop("share")
    gone = checkpointed(gone)
    judges = mining.judge(checkpointed(nw.without_edges(every(t), gone)), nw.reduced(every(v), gone), length)
    named = F.concat(at("theta"), F.lit("/"), F.element_at("id", 2))
    judges = judges.withColumn("theta", F.explode(F.array(*map(F.lit, thetas)))).withColumn("id", F.split("model_id", "/")).withColumn("model_id", F.element_at("id", 1))
    judges = checkpointed(judges.withColumn("model_id", named).drop("theta", "id"))
    return found, judges


def _judged(found: DataFrame, judges: DataFrame, shares: tuple[float, ...] = (REMOVED,)) -> DataFrame:
    """Specifications of all attempts by all judges: an attempt is copied for each share."""
    each = found.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    each = each.withColumn("model_id", F.format_string("%s/%.2f", "model_id", "share"))
    return mining.comparison_based(checkpointed(each.drop("share")), judges)


def _named(specs: DataFrame) -> DataFrame:
    """Splits model ids network@theta/share."""
    part = F.split("model_id", "[@/]")
    return specs.withColumn("theta", F.element_at(part, 2).cast("double")).withColumn("share", F.try_element_at(part, F.lit(3)).cast("double")).withColumn("model_id", F.element_at(part, 1))


@query("cb_specs")
def _(spark, sf_dir):
    """Comparison-based specifications; which are kept depends on the order of paths, so there is no SQL (tests compare worked cases and a plain loop)."""
    specs = _named(_judged(*_mined(spark, sf_dir)))
    return specs.select("model_id", "path_id", F.round("probability", 9).alias("probability"), "ltl", "height", "leaves", "names", "n_merged", "loose")


@query("mb_specs")
def _(spark, sf_dir):
    """Metric-based specifications."""
    specs = _named(mining.metric_based(_mined(spark, sf_dir)[0]))
    return specs.select("model_id", "path_id", F.round("probability", 9).alias("probability"), "ltl", "height", "leaves", "names", "n_merged", "loose")


@query("spec_lines")
def _(spark, sf_dir):
    """Specifications of both miners as lines of text, written and read back."""
    found, judges = _mined(spark, sf_dir)
    both = _judged(found, judges).union(mining.metric_based(found)).where("ltl IS NOT NULL")
    path = work_path(spark)
    write_specs(both, path)
    return spark.read.text(path)


@query("spec_height_hist")
def _(spark, sf_dir):
    """How many specifications of each miner have which height and number of different names, beside the fixed sizes of the invariants."""
    found, judges = _mined(spark, sf_dir)
    both = _judged(found, judges).withColumn("miner", F.lit("comparison")).union(mining.metric_based(found).withColumn("miner", F.lit("metric")))
    own = both.where("ltl IS NOT NULL").groupBy("miner", "height", "names").agg(F.count("*").alias("n"))
    kinds = tr.invariant_summary(tr.invariants(tr.pair_counts(c._tokens(spark, sf_dir)), 0.8)).select(F.lit("invariants").alias("miner"), "height", F.col("leaves").alias("names"), "n")
    return own.union(kinds)


SWEEP_THETAS, SWEEP_SHARES = (0.7, 0.72, 0.75, 0.8), (0.0, 0.25, 0.5, 0.75)


@query("specs_by_removed_edges")
def _(spark, sf_dir):
    """Specifications per network, on average, for each threshold and share of removed cross edges; all networks, thresholds and shares are one job."""
    specs = _named(_judged(*_mined(spark, sf_dir, SWEEP_THETAS, SWEEP_SHARES), SWEEP_SHARES))
    n = specs.groupBy("theta", "share").agg((F.count("*") / MODELS).alias("mean_specs"), F.avg("probability").alias("probability"), F.avg(F.col("loose").cast("int")).alias("loose"))
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, SWEEP_THETAS))).alias("theta")).select("theta", F.explode(F.array(*map(F.lit, SWEEP_SHARES))).alias("share"))
    return grid.join(n, ["theta", "share"], "left").fillna(0.0, ["mean_specs"])


@query("specs_by_miner")
def _(spark, sf_dir):
    """Specifications per network, on average, for each threshold and both miners, and the share of them that is loose."""
    found, judges = _mined(spark, sf_dir, SWEEP_THETAS)
    both = _judged(found, judges).withColumn("miner", F.lit("comparison")).union(mining.metric_based(found).withColumn("miner", F.lit("metric")))
    return _named(both).groupBy("miner", "theta").agg((F.count("*") / MODELS).alias("mean_specs"), F.avg(F.col("loose").cast("int")).alias("loose"))
