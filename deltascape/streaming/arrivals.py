"""Candidates that arrive over time, beyond batch use: repeats dropped within a watermark, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_id", by: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """By window and class: arrivals and their mean value, each key counted once. Works on streams and on tables alike."""
    once = events.withWatermark(time, late)
    once = once.dropDuplicatesWithinWatermark([key]) if events.isStreaming else once.dropDuplicates([key])
    counts = once.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "mean_value")
