"""Distances, grid cells and coverage on longitude and latitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres; the mean earth radius of the spherical formulas.
RADIUS = 6_371_008.8
DEGREE = math.pi * RADIUS / 180


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> Column:
    """Struct of lon and lat after a way along a great circle."""
    d, b, p = metres / RADIUS, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.struct((F.pmod(lon + F.degrees(turn) + 540, F.lit(360.0)) - 180).alias("lon"), F.degrees(q).alias("lat"))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def near_cells(df: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """Each row once for its own cell and each of the eight around it, as ``gx`` and ``gy``."""
    shifts = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    out = df.withColumn("__s", F.explode(shifts))
    return out.withColumns({"gx": cell(F.col(lon), size) + F.col("__s.dx"), "gy": cell(F.col(lat), size) + F.col("__s.dy")}).drop("__s")


def in_own_cell(df: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    return df.withColumns({"gx": cell(F.col(lon), size), "gy": cell(F.col(lat), size)})


#: How many radii (or minutes) each context takes, and their bounds.
LIMITS = {"vector": (6, 1, 5_000), "settlement": (8, 50, 5_000), "population": (8, 1, 10_000), "minutes": (8, 1, 120)}


def context_radii(family: str, values: list[float]) -> list[float]:
    return radii(values, *LIMITS[family])


def cell_size(metres: float, latitude: float = 10.0) -> float:
    """Degrees that span ``metres`` both ways up to this latitude."""
    return metres / (DEGREE * math.cos(math.radians(latitude)))


def up_to_latitude(df: DataFrame, lat: str, most: float) -> DataFrame:
    """The rows; one further from the equator than ``most`` is an error, since cells would be too narrow there."""
    ok = F.when(F.abs(F.col(lat)) > most, F.raise_error(F.lit("LATITUDE_BEYOND_CELLS")).cast("double")).otherwise(F.col(lat))
    return df.withColumn(lat, ok)


def radii(values: list[float], most: int, low: float, high: float) -> list[float]:
    """Distinct radii in ascending order; none, too many, or one outside the bounds is an error."""
    found = sorted(set(values))
    if not 1 <= len(found) <= most or found[0] < low or found[-1] > high or found[0] <= 0:
        raise ValueError("RADII_INVALID")
    return found


def box_covers(lon: Column, lat: Column, metres: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a circle lies within a box."""
    dlat = metres / DEGREE
    dlon = metres / (DEGREE * F.cos(F.radians(lat)))
    return (lon - dlon >= west) & (lon + dlon <= east) & (lat - dlat >= south) & (lat + dlat <= north)
