"""Windowed aggregates that run alike on batch tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by tumbling window; rows later than `late` are dropped in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    made = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")
