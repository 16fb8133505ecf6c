"""Top rows per key, and duplicate guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, as ``DISTINCT ON`` would give it."""
    return top_per(df, keys, order, 1).drop("rank")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def coherent_head(snapshots: DataFrame, rows: DataFrame, keys: list[str], order: list[Column], snapshot: str = "snapshot_id") -> DataFrame:
    """All rows of each key's newest snapshot, never a mixture of snapshots."""
    return first_per(snapshots, keys, order).select(*keys, snapshot).join(rows, [*keys, snapshot])
