"""Telemetry as a stream: windowed counts and means of events, late events dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, failures and mean value by window; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    each = timed.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.round(F.avg("value"), 4).alias("mean"))
    return each.select(F.col("window.start").alias("start"), "n", "n_failed", "mean")
