"""Networks learned from logs in which the events of several origins are interleaved.

A log's events become signals, one for each origin, whose number and lengths come from the rows. A vertex is a place in a signal's sample; its parents are the
place before it in its own signal, and the same place of the signal that is most often directly before it in the merged logs. So an edge between origins is
what interleaving alone suggests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usual_before(steps: DataFrame) -> DataFrame:
    """Rows (model_id, signal, other): of all other signals the one that is most often directly before ``signal``, of several the first by name. ``steps``: rows
    (model_id, cur, nxt) of neighbours in merged logs."""
    n = steps.where("cur <> nxt").groupBy("model_id", F.col("nxt").alias("signal"), F.col("cur").alias("other")).agg(F.count("*").alias("n"))
    first = Window.partitionBy("model_id", "signal").orderBy(F.desc("n"), "other")
    return n.withColumn("place", F.row_number().over(first)).where("place = 1").select("model_id", "signal", "other")


def structure(values: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (model_id, vertex, parents) of the signals in ``values`` (model_id, signal, idx): a vertex for each idx from 0 to a signal's largest."""
    lengths = values.groupBy("model_id", "signal").agg(F.max("idx").cast("int").alias("last"))
    other = lengths.select("model_id", F.col("signal").alias("other"), F.col("last").alias("other_last"))
    s = lengths.join(before, ["model_id", "signal"], "left").join(other, ["model_id", "other"], "left")
    s = s.select("model_id", "signal", "other", "other_last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("idx"))
    name = lambda c: F.concat(c, F.lit("_"), (F.col("idx") - 1).cast("string"))
    own = F.when(F.col("idx") > 0, F.array(name("signal"))).otherwise(F.array().cast("array<string>"))
    cross = F.when((F.col("idx") > 0) & (F.col("idx") - 1 <= F.col("other_last")), F.array(name("other"))).otherwise(F.array().cast("array<string>"))
    return s.select("model_id", F.concat("signal", F.lit("_"), F.col("idx").cast("string")).alias("vertex"), F.concat(own, cross).alias("parents"))


def observations(values: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows (model_id, vertex, parents, parent_vals, outcome) from ``values`` (model_id, log, sample, signal, idx, value): one for each vertex of a sample that it and all
    its parents have a value for, the largest of several. A sample's values are one row; the vertices of a model are one row, too, so models meet samples by a small join."""
    none = F.array().cast("array<string>")
    # One shuffle, by sample, for both sums.
    one = values.where("value IS NOT NULL").repartition("model_id", "log", "sample").groupBy("model_id", "log", "sample", "signal", "idx").agg(F.max("value").alias("value"))
    pair = F.struct(F.concat("signal", F.lit("_"), F.col("idx").cast("string")), "value")
    samples = one.groupBy("model_id", "log", "sample").agg(F.map_from_entries(F.collect_list(pair)).alias("at"))
    models = vertices.groupBy("model_id").agg(F.collect_list(F.struct("vertex", F.coalesce("parents", none).alias("parents"))).alias("net"))
    each = samples.join(models, "model_id").select("model_id", "at", F.explode("net").alias("v")).select("model_id", "v.vertex", "v.parents", F.transform("v.parents", lambda p: F.col("at")[p]).alias("parent_vals"), F.col("at")[F.col("v.vertex")].alias("outcome"))
    return each.where(F.col("outcome").isNotNull() & ~F.exists("parent_vals", lambda x: x.isNull()))
