"""Structured Streaming entry points for event timelines.

All take a streaming frame with ts TIMESTAMP (the events table's TIMESTAMP_NTZ is cast), user_id and event_type, keep
state by watermark, and give append-mode frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, length: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and distinct types of each user in tumbling windows."""
    return prepared(events, late).groupBy(F.window("ts", length), "user_id").agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("event_type").alias("types"))


def sliding_counts(events: DataFrame, length: str = "60 seconds", step: str = "50 seconds", late: str = "10 minutes") -> DataFrame:
    return prepared(events, late).groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, gap: str = "4100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Runs of one type of a user with gaps below `gap`, closed once the watermark passes."""
    return prepared(events, late).groupBy(F.session_window("ts", gap), "user_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("peak"))


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return prepared(events, late).dropDuplicatesWithinWatermark(["event_id"])
