"""Co-occurrence invariants of an event stream, whatever the order in which events arrive.

A trace is cut into segments of time. The state of a segment holds its events' places; a batch that brings events for it gives a new
version of its summary: how many events of each type it has, and for pairs of types how many have the other one before or after them in
the segment. Summaries of a trace add up to the counts of the whole trace, so a trace with most of the events is many states, and only
segments that a batch touches are looked at again.

Every batch writes the versions that it made to a folder named by its number. A batch that is repeated after a failure replaces what it wrote
before, and the newest version of a segment counts.

With a watermark (``late``), the state of a segment goes when the watermark has passed its end, and events older than the watermark are left
out; without one, any event counts, and all places are kept. Events without a time or a type take no part. A null key is a trace. Events at
one time are ordered by their id, then by type; repeated events count each. An empty stream has no counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = "k long, segment long, types array<struct<t: string, n: long>>, pairs array<struct<a: string, b: string, precedes: long, follows: long>>"


def summary(types: Column) -> tuple[Column, Column]:
    """Of a segment's event types in order: (t, n) for each type, and (a, b, precedes, follows) for pairs of different types: events b after the first a, and
    events a before the last b."""
    names = F.array_sort(F.array_distinct(types))
    long = lambda c: c.cast("long")
    after = lambda a: F.slice(types, F.array_position(types, a).cast("int") + 1, F.size(types))
    before = lambda b: F.slice(types, 1, F.size(types) - F.array_position(F.reverse(types), b).cast("int"))
    among = lambda part, t: long(F.size(F.filter(part, lambda x: x == t)))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"), among(after(a), b).alias("precedes"), among(before(b), a).alias("follows"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b != a), lambda b: pair(a, b))))
    return F.transform(names, lambda t: F.struct(t.alias("t"), among(types, t).alias("n"))), pairs


def segment_summaries(events: DataFrame, key: str = "user_id", segment: str = "1 day", late: str | None = None) -> DataFrame:
    """A stream of rows (k, segment, types, pairs): new versions of the summaries of segments (the seconds at which they begin), in update mode. ``key`` is a
    whole number."""
    t = events.withColumn("_time", F.col("ts").cast("timestamp")).where("_time IS NOT NULL AND event_type IS NOT NULL")
    if late:
        t = t.withWatermark("_time", late)
    place = F.struct(F.col("_time").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    held = t.groupBy(F.col(key).cast("long").alias("k"), F.window("_time", segment).alias("w")).agg(F.sort_array(F.collect_list(place)).alias("places"))
    held = held.select("k", F.unix_seconds("w.start").alias("segment"), F.col("places.type").alias("order"))
    types, pairs = summary(F.col("order"))
    return held.select("k", "segment", types.alias("types"), pairs.alias("pairs"))


def run_to_end(summaries: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all that is there, or goes on where it ended, and gives the newest summary of each segment under ``path``."""
    spark = summaries.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    q = summaries.writeStream.outputMode("update").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    found = spark.read.schema(f"{SUMMARY}, batch long").parquet(f"{path}/versions*")
    newest = F.max_by(F.struct("types", "pairs"), "batch").alias("s")
    return found.groupBy("k", "segment").agg(newest).select("k", "segment", "s.*")


def pair_counts(newest: DataFrame) -> DataFrame:
    """Rows (a, b, n_a, n_b, precedes, follows) of whole traces, as ``traces.pair_counts`` has them, from the summaries of their segments.

    After the first segment that has an a, every b has one before it; in that segment, the summary tells. So segments are compared with a trace's first and last
    segment of each type, not with each other.
    """
    types = newest.select("k", "segment", F.explode("types").alias("x")).select("k", "segment", "x.t", "x.n")
    ends = types.groupBy("k", "t").agg(F.min("segment").alias("first"), F.max("segment").alias("last"))
    whole = types.alias("x").join(ends.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.t") != F.col("y.t")))
    whole = whole.select(F.col("x.t").alias("e"), F.col("y.t").alias("t"), F.when(F.col("segment") > F.col("first"), F.col("n")).otherwise(0).alias("earlier"), F.when(F.col("segment") < F.col("last"), F.col("n")).otherwise(0).alias("later"))
    inside = newest.select("k", "segment", F.explode("pairs").alias("p")).select("k", "segment", "p.*")
    first = ends.select(F.col("k").alias("fk"), F.col("t").alias("a"), F.col("first").alias("segment"))
    last = ends.select(F.col("k").alias("lk"), F.col("t").alias("b"), F.col("last").alias("segment"))
    before = inside.alias("i").join(first.alias("f"), F.expr("i.k <=> fk AND i.a = f.a AND i.segment = f.segment")).select(F.col("i.b").alias("e"), F.col("i.a").alias("t"), F.col("precedes").alias("earlier"), F.lit(0).alias("later"))
    after = inside.alias("i").join(last.alias("l"), F.expr("i.k <=> lk AND i.b = l.b AND i.segment = l.segment")).select(F.col("i.a").alias("e"), F.col("i.b").alias("t"), F.lit(0).alias("earlier"), F.col("follows").alias("later"))
    counts = whole.union(before).union(after).groupBy("e", "t").agg(F.sum("earlier").alias("earlier"), F.sum("later").alias("later"))
    total = types.groupBy("t").agg(F.sum("n").alias("n"))
    a, b = total.select(F.col("t").alias("a"), F.col("n").alias("n_a")), total.select(F.col("t").alias("b"), F.col("n").alias("n_b"))
    pairs = counts.select(F.col("t").alias("a"), F.col("e").alias("b"), F.col("earlier").alias("precedes")).join(counts.select(F.col("e").alias("a"), F.col("t").alias("b"), F.col("later").alias("follows")), ["a", "b"], "full")
    # Types that no trace has both of: a row of all types, as in the batch operator.
    every = total.agg(F.collect_list("t").alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a <> b")
    return every.join(a, "a").join(b, "b").join(pairs, ["a", "b"], "left").fillna(0, ["precedes", "follows"]).select("a", "b", "n_a", "n_b", "precedes", "follows")
