"""Windows over timed events; the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of each window; with a watermark, rows that come later than it are dropped."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    got = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_s: int) -> DataFrame:
    """(user_id, session, n, start, end): runs of a user's events less than a gap apart, for a batch."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    since = at - F.lag(at).over(w)
    new = F.when(since.isNull() | (since > gap_s * 1_000_000), 1).otherwise(0)
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def stream_sessions(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """(user_id, start, end, n) of each session of a stream."""
    got = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
