"""Session views of an event stream: an addition, for streams, to the batch views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and duration per user and session window; the same plan for a batch and for a stream."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    d = d.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return d.select("user_id", F.col("w.start").alias("session_start"), F.col("n_events").cast("long").alias("n_events"), F.round("total", 4).alias("total"), (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))).alias("duration_us"))


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
