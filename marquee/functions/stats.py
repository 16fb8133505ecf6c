"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 6) -> Column:
    """Halves go towards plus infinity, also below zero (Spark's ``round`` goes away from zero)."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def midrank(value: Column, *partition: Column) -> Column:
    """100 x (rows below + half of the rows equal) / rows, within the partition."""
    whole: WindowSpec = W.partitionBy(*partition)
    below = F.rank().over(whole.orderBy(value)) - 1
    equal = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return 100.0 * (below + 0.5 * equal) / F.count(F.lit(1)).over(whole)


def evidence_score(source: Column, validation: Column, temporal: Column, granularity: Column, completeness: Column, minimum: Column, caps: Column) -> Column:
    raw = 0.25 * source + 0.25 * validation + 0.2 * temporal + 0.2 * granularity + 0.1 * completeness
    return F.least(raw, minimum + 15, F.array_min(caps))


def evidence_grade(score: Column, zero_critical: Column) -> Column:
    return F.when(zero_critical | (score < 40), "unavailable").when(score < 55, "D").when(score < 70, "C").when(score < 85, "B").otherwise("A")


def relative_direction(left: Column, right: Column) -> Column:
    """higher, lower or similar (within 5 % of the larger magnitude)."""
    top = F.greatest(F.abs(left), F.abs(right))
    return F.when(left.isNull() | right.isNull(), None).when((top == 0) | (F.abs(left - right) / F.nullif(top, F.lit(0.0)) <= 0.05), "similar").when(left > right, "higher").otherwise("lower")


def compactness(area: Column, perimeter: Column) -> Column:
    import math

    return F.when(perimeter > 0, F.least(F.lit(1.0), 4 * math.pi * area / (perimeter * perimeter)))
