"""Extensions: the batch operators that have a streaming form. Each takes a streaming (or batch) frame of events with `at` as event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.timestamp_seconds("ts"))


def live_subsessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(session, start, end, n): sub-sessions that close after a gap, late events allowed for."""
    return events.withWatermark("at", late).groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_popularity(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(hour, aid, type, n): events by hour, item and type."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "aid", "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "aid", "type", "n")
