"""The query log as a stream: latest state of each request, and rate windows with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_windows(events: DataFrame, key: str, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes", limit: int = 20) -> DataFrame:
    """Windows in which a key made more than `limit` requests. Works on batches and on streams."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(key, F.col("window.start").alias("start"), "n")


def latest_state(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value of each key; on a stream an update-mode aggregate."""
    return events.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
