"""Streaming forms of resampling, moving rates and session cutting: event-time windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, width: str = "10 milliseconds", late: str = "1 minute") -> DataFrame:
    """Mean of each bin of samples ``key, ts, v``."""
    return stream.withWatermark("ts", late).groupBy("key", F.window("ts", width)).agg(F.avg("v").alias("v")).select("key", F.col("window.start").alias("ts"), "v")


def moving_rate(stream: DataFrame, width: str = "6 seconds", slide: str = "1 second", seconds: float = 6.0, late: str = "1 minute") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("key", F.window("ts", width, slide)).agg((F.count("*") / seconds).alias("rate")).select("key", F.col("window.start").alias("ts"), "rate")


def sessions(stream: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Recordings cut where a key is silent for ``gap``."""
    return stream.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("end"), "n")
