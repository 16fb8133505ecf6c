"""Ranks of values among a large cohort without a total order in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mid_ranks(cohort: DataFrame, asked: DataFrame, ranges: int = 64) -> DataFrame:
    """For each distinct value of ``asked``: how many of ``cohort`` lie below it, how many equal it, and how many there are.

    Both frames have ``value``; nulls are no members and are not answered.  Values are counted first, so a frequent one
    is a single row.  Approximate percentiles of the distinct values cut them into ranges; a range's rows are ranked in
    one task, and the members of the ranges before it are a sum over as many rows as there are ranges.
    """
    members = cohort.select("value", F.lit(1).cast("long").alias("n"), F.lit(False).alias("asked"))
    both = members.unionByName(asked.select("value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))).where(F.col("value").isNotNull())
    counted = both.groupBy("value").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    cuts = counted.agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("cuts"))
    # One row; the number of a value's range is the number of cuts below it.
    placed = counted.crossJoin(F.broadcast(cuts)).select("value", "n", "asked", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0)).alias("range"))
    sizes = placed.groupBy("range").agg(F.sum("n").alias("n"))
    every = Window.orderBy("range")
    before = sizes.select(F.col("range").alias("at"), (F.sum("n").over(every) - F.col("n")).alias("before"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("value"))
    ranked = placed.withColumn("upto", upto).where("asked").join(F.broadcast(before), F.col("range") == F.col("at"))
    return ranked.select("value", (F.col("before") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("same"), "total")
