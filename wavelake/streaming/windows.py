"""Streaming forms: windowed statistics with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import statistics


def windowed(stream: DataFrame, ts: str, key: list[str], value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Statistics of each key and time window; rows later than `late` are left out (median needs no ordered state and is left to batch)."""
    stats = statistics(F.col(value))
    grouped = stream.withWatermark(ts, late).groupBy(*key, F.window(ts, length, slide or length))
    return grouped.agg(*(c.alias(k) for k, c in stats.items())).select(*key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *stats)
