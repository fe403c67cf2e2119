"""Event traces: positions, co-occurrence invariants, samples, intervals, chunks and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIXED_COMPLEXITY = {"precedes": (2, 2), "follows": (3, 2), "not_followed": (4, 2)}


def positions(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Adds ``pos``, the place of an event in its trace, by (ts, event_id).

    Places are counted within a trace's days and shifted by the sizes of the days before, so that a trace with most of
    the events is many groups.
    """
    dated = events.withColumn("_day", F.to_date("ts"))
    within = Window.partitionBy(key, "_day").orderBy("ts", "event_id")
    placed = dated.withColumn("_in_day", F.row_number().over(within) - 1)
    before = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.count("*").alias("_n"))
    days = days.select("_k", "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    both = placed.join(days, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")))
    return both.withColumn("pos", F.col("_shift") + F.col("_in_day")).drop("_day", "_in_day", "_k", "_d", "_shift")


def transitions(placed: DataFrame, key: str = "user_id") -> DataFrame:
    """Pairs (cur, nxt) of neighbouring events of a trace; the join key is the place, so long traces spread."""
    cur = placed.select(F.col(key).alias("k"), F.col("pos").alias("at"), F.col("event_type").alias("cur"))
    nxt = placed.select(F.col(key).alias("k"), (F.col("pos") - 1).alias("at"), F.col("event_type").alias("nxt"))
    return cur.join(nxt, ["k", "at"])


def steps(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The pairs (k, cur, nxt) of ``transitions`` without places: neighbours within a day by one window, and the last event of a day with the
    first of the trace's next day."""
    dated = events.select(F.col(key).alias("k"), F.to_date("ts").alias("d"), "ts", "event_id", "event_type")
    ahead = Window.partitionBy("k", "d").orderBy("ts", "event_id")
    inner = dated.select("k", F.col("event_type").alias("cur"), F.lead("event_type").over(ahead).alias("nxt")).where("nxt IS NOT NULL")
    place = F.struct("ts", "event_id")
    days = dated.groupBy("k", "d").agg(F.min_by("event_type", place).alias("first"), F.max_by("event_type", place).alias("cur"))
    border = days.select("k", "cur", F.lead("first").over(Window.partitionBy("k").orderBy("d")).alias("nxt")).where("nxt IS NOT NULL")
    return inner.union(border)


def transition_cpt(pairs: DataFrame) -> DataFrame:
    """Rows (cur, nxt, n, p, w): counted transition probabilities and their metric."""
    n = pairs.groupBy("cur", "nxt").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cur"))
    return n.select("cur", "nxt", "n", p.alias("p"), (1 - p).alias("w"))


def by_time() -> Column:
    """What orders events as ``positions`` does: (ts, event_id), and the type where rows repeat both."""
    return F.struct("ts", "event_id", "event_type")


def pair_counts(placed: DataFrame, key: str = "user_id", place: Column | str = "pos") -> DataFrame:
    """Rows (a, b, n_a, n_b, precedes, follows) for ordered pairs of different event types.

    ``precedes``: events b with an a earlier in their trace; ``follows``: events a with a b later in theirs. A trace gives the first and
    last place of each type, and events are compared with those, not with each other. ``place`` is anything that orders a trace's events, such as
    ``by_time()``, which needs no positions.
    """
    types = placed.groupBy(F.col(key).alias("k"), F.col("event_type").alias("t")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    place = F.col(place) if isinstance(place, str) else place
    seen = placed.join(types, F.col(key).eqNullSafe(F.col("k"))).where("event_type <> t")
    counts = seen.groupBy(F.col("event_type").alias("e"), "t").agg(F.count(F.when(F.col("first") < place, 1)).alias("earlier"), F.count(F.when(F.col("last") > place, 1)).alias("later"))
    total = placed.groupBy(F.col("event_type").alias("e")).agg(F.count("*").alias("n"))
    every = total.agg(F.collect_list(F.struct("e", "n")).alias("all"))  # a row with all event types
    pairs = every.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.e <> y.e")
    pairs = pairs.select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    before = counts.select(F.col("t").alias("a"), F.col("e").alias("b"), F.col("earlier").alias("precedes"))
    after = counts.select(F.col("e").alias("a"), F.col("t").alias("b"), F.col("later").alias("follows"))
    return pairs.join(before, ["a", "b"], "left").join(after, ["a", "b"], "left").fillna(0, ["precedes", "follows"])


def invariants(counts: DataFrame, threshold: float) -> DataFrame:
    """Rows (kind, a, b, ratio): precedes and follows at or above the threshold, and pairs that never follow (no ratio)."""
    precedes = counts.select(F.lit("precedes").alias("kind"), "a", "b", (F.col("precedes") / F.col("n_b")).alias("ratio")).where((F.col("ratio") >= threshold) & (F.col("ratio") > 0))
    follows = counts.select(F.lit("follows").alias("kind"), "a", "b", (F.col("follows") / F.col("n_a")).alias("ratio")).where((F.col("ratio") >= threshold) & (F.col("ratio") > 0))
    never = counts.where("follows = 0").select(F.lit("not_followed").alias("kind"), "a", "b", F.lit(None).cast("double").alias("ratio"))
    return precedes.union(follows).union(never)


def invariant_summary(found: DataFrame) -> DataFrame:
    """Rows (kind, height, leaves, n): how many invariants have which formula size."""
    size = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in FIXED_COMPLEXITY.items() for x in (k, v[i])]), F.col("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n")).select("kind", size(0).alias("height"), size(1).alias("leaves"), "n")


def false_positives(found: DataFrame, first_only: bool = False) -> DataFrame:
    """Rows (kind, n, n_false): invariants between tokens of different origin, which their first two characters tell. ``first_only``: pairs that
    never follow count as false if the first two characters of their first token differ from each other."""
    differ = F.substring("a", 1, 2) != F.substring("b", 1, 2)
    if first_only:
        differ = F.when(F.col("kind") == "not_followed", F.substring("a", 1, 1) != F.substring("a", 2, 1)).otherwise(differ)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(differ, 1)).alias("n_false"))


def samples(placed: DataFrame, length: int, key: str = "user_id") -> DataFrame:
    """Rows (key, sample, events): whole runs of ``length`` events as ordered arrays of (pos, event_type, value, ts)."""
    run = F.floor(F.col("pos") / length).cast("long").alias("sample")
    rows = placed.groupBy(key, run).agg(F.sort_array(F.collect_list(F.struct("pos", "event_type", "value", "ts"))).alias("events"))
    return rows.where(F.size("events") == length)


def intervals(placed: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows (key, pos, event_type, start, end): a state holds until the next of its type; the last one until 1.5 times the trace's
    time. Times are seconds since the trace began."""
    begin = placed.groupBy(F.col(key).alias("k")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    t = placed.withColumn("_d", F.to_date("ts")).join(begin, F.col(key).eqNullSafe(F.col("k"))).withColumn("start", seconds("ts") - seconds("t0")).drop("k")
    # The next of its type: within the day, or the first one of the next day that has any. So a long trace is many groups.
    ahead = Window.partitionBy(key, "event_type", "_d").orderBy("pos")
    t = t.withColumn("_next", F.lead("start").over(ahead))
    days = t.groupBy(F.col(key).alias("k"), F.col("event_type").alias("e"), F.col("_d").alias("d")).agg(F.min("start").alias("first"))
    days = days.select("k", "e", "d", F.lead("first").over(Window.partitionBy("k", "e").orderBy("d")).alias("later"))
    t = t.join(days, F.col(key).eqNullSafe(F.col("k")) & F.col("event_type").eqNullSafe(F.col("e")) & F.col("_d").eqNullSafe(F.col("d")))
    return t.select(key, "pos", "event_type", "start", F.coalesce("_next", "later", (seconds("t1") - seconds("t0")) * 1.5).alias("end"))


def chunks(found: DataFrame, size: int, key: str = "user_id") -> DataFrame:
    """Rows (key, trace, sample, pos_in_trace, event_type): ``size`` samples make a trace; an incomplete last one is dropped."""
    trace = F.floor(F.col("sample") / size).cast("long")
    full = found.groupBy(F.col(key).alias("k"), trace.alias("tr")).agg(F.count("*").alias("n")).where(F.col("n") == size).drop("n")
    t = found.withColumn("trace", trace).join(full, F.col(key).eqNullSafe(F.col("k")) & (F.col("trace") == F.col("tr")))
    t = t.select(key, "trace", "sample", F.posexplode("events").alias("i", "e"))
    in_trace = (F.col("sample") - F.col("trace") * size) * 1000 + F.col("i")
    at = Window.partitionBy(key, "trace").orderBy(in_trace)
    return t.select(key, "trace", "sample", (F.row_number().over(at) - 1).alias("pos_in_trace"), F.col("e.event_type").alias("event_type"))


def interleaved(placed: DataFrame, groups: int, key: str = "user_id") -> DataFrame:
    """Rows (log, pos, token): traces of ``groups`` origins merged by time. The tokens carry their origin; a log is a set of traces of
    one day, so that logs stay small."""
    origin = F.pmod(F.col(key), F.lit(groups))
    log = F.format_string("%s/%d", F.date_format("ts", "yyyy-MM-dd HH"), F.floor(F.col(key) / groups) % 8)
    t = placed.select(log.alias("log"), F.format_string("F%d.%s", origin, F.col("event_type")).alias("token"), "ts", "event_id")
    return t.select("log", (F.row_number().over(Window.partitionBy("log").orderBy("ts", "event_id")) - 1).alias("pos"), "token")


def token_traces(found: DataFrame, size: int, origin, signal: str = "E", key: str = "user_id") -> DataFrame:
    """Rows (key, trace, token, t): ``size`` samples (key, sample, events) make a trace of tokens F<origin>.<signal>=<value>. A sample's times start at
    0 and are shifted to 0.1 seconds after the last one of the sample before it in the trace; incomplete traces are dropped."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    trace = F.floor(F.col("sample") / size).cast("long")
    s = found.select(key, trace.alias("trace"), "sample", F.transform("events", lambda e: F.struct(((micros(e["ts"]) - micros(F.col("events")[0]["ts"])) / 1e6).alias("t"), e["event_type"].alias("value"))).alias("events"))
    in_trace = Window.partitionBy(key, "trace")
    before = in_trace.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("shift", F.coalesce(F.sum(F.array_max("events.t") + 0.1).over(before), F.lit(0.0))).withColumn("n", F.count("*").over(in_trace)).where(F.col("n") == size)
    s = s.select(key, "trace", "sample", "shift", F.posexplode("events").alias("i", "e"))
    return s.select(key, "trace", "sample", "i", F.format_string(f"F%d.{signal}=%s", origin, F.col("e.value")).alias("token"), (F.col("shift") + F.col("e.t")).alias("t"))


def merged_logs(traces: DataFrame, log: list) -> DataFrame:
    """Traces of several origins merged by time: rows of ``token_traces`` with their place ``pos`` in the log that the columns ``log`` name. A log is as
    long as the traces in it."""
    return traces.withColumn("pos", F.row_number().over(Window.partitionBy(*log).orderBy("t", "token", "sample", "i")) - 1)
