"""Item popularity over an event stream: windowed counts with a watermark (an extension; the batch counts are in operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums of ``value`` per window and event_type; events later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
