"""Streaming history: per-key counts and last times kept as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(stream: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events, sum of values and last time by user and tumbling window; works on streams and static tables alike.
    Rows later than ``lateness`` behind the newest are dropped from a stream."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "user_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts")).select(F.col("w.start").alias("start"), "user_id", "n", "total", "last_ts")
