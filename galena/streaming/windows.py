"""Streaming twins: late data is dropped by a watermark, state is kept by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def feature_windows(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Count, mean and extremes per event_type and tumbling window of a stream (event_id, ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without redelivered events, whose ids are remembered as long as the watermark asks."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
