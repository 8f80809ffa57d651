"""Hopping and session summaries of an unbounded event table; late rows are dropped after the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hopping_summary(events: DataFrame, length: str = "2 hours", hop: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """event_type, start, n, total and highest value for each window; works on a stream and on a table alike."""
    out = timed(events, late).groupBy(F.window("ts", length, hop).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total", "highest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
