"""Event counts by window, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and summed values per window and type; a streaming frame needs a watermark beforehand."""
    found = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return found.select(F.col("window.start").alias("window_start"), "event_type", "n_events", F.round(F.col("total").cast("double"), 4).alias("total"))


def stream_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts over a stream; a repeated event id within the allowed lateness counts once."""
    return window_counts(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), width)
