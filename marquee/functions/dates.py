"""Flight days and exposure blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes of the day of each part.
DAYPARTS = {"am": (360, 600), "midday": (600, 900), "pm": (900, 1140), "evening": (1140, 1380)}
MAX_DAYS = 366


def flight_days(start: Column, end: Column) -> Column:
    """Days including both ends; a flight that ends before it starts or exceeds a year is an error."""
    days = F.datediff(end, start) + 1
    return F.when(days.isNull() | (days < 1), F.raise_error(F.lit("INVALID_FLIGHT_DATES")).cast("int")).when(days > MAX_DAYS, F.raise_error(F.lit("FLIGHT_OUTSIDE_MVP_ENVELOPE")).cast("int")).otherwise(days)


def exposure_blocks(df: DataFrame, start: str, end: str, daypart: str) -> DataFrame:
    """One row per day and part of the day of each flight; ``all_day`` means all four parts."""
    parts = F.array(*[F.struct(F.lit(n).alias("daypart"), F.lit(a).alias("start_minute"), F.lit(b).alias("end_minute")) for n, (a, b) in DAYPARTS.items()])
    wanted = F.filter(parts, lambda p: (F.col(daypart) == "all_day") | (p["daypart"] == F.col(daypart)))
    out = df.withColumn("block_date", F.explode(F.sequence(F.col(start), F.col(end)))).withColumn("__p", F.explode(wanted))
    return out.select("*", F.col("__p.daypart").alias("block_daypart"), "__p.start_minute", "__p.end_minute", ((F.col("__p.end_minute") - F.col("__p.start_minute")) / 60.0).alias("duration_hours")).drop("__p")
