"""Windowed counts over event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(
    events: DataFrame, labels: Sequence[str], size: str, slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Events per window and label set. Rows later than ``delay`` are dropped, closed windows emitted."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"), *labels)
        .agg(F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("good"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "events", "good")
    )


def windowed_rates(events: DataFrame, labels: Sequence[str], size: str, delay: str = "10 minutes") -> DataFrame:
    counts = windowed_counts(events, labels, size, delay=delay)
    seconds = F.unix_seconds("window_end") - F.unix_seconds("window_start")
    return counts.withColumn("rate", F.col("events") / seconds)
