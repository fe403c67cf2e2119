"""Event streams: counts in tumbling windows, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows (start, event_type, n) of windows that the watermark has passed."""
    t = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return t.groupBy(F.window("time", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote under ``path``."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
