"""Points in polygons, polygons near sites, and map files cut by a box, all as expressions and joins on grid cells.

A polygon is ``rings``: an array of rings, each an array of lon/lat structs, the first the outer one, holes after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import geo
from marquee.operators.heads import first_per
from marquee.operators.spatial import local_xy, tasks


def edges(ring: Column) -> Column:
    """Pairs of consecutive corners, the last one with the first."""
    # The ring is read a few times and not once a corner, also where it is itself an expression.
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_ring(ring: Column, lon: Column, lat: Column) -> Column:
    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        cross = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
        return (F.abs(cross) <= 1e-15) & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(edges(ring), on)


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a ray from the point to the east crosses the ring an odd number of times."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        return ((ay > lat) != (by > lat)) & (lon < ax + (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)))

    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def covers(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a polygon covers a point; its boundary, that of holes included, belongs to it."""
    inside = F.aggregate(rings, F.lit(False), lambda a, r: a != in_ring(r, lon, lat))
    return inside | F.exists(rings, lambda r: on_ring(r, lon, lat))


def boxed(polygons: DataFrame, margin: Column | float = 0.0) -> DataFrame:
    """Polygons with the bounds of their outer ring, widened by a margin in degrees."""
    outer = F.get("rings", F.lit(0))
    m = margin if isinstance(margin, Column) else F.lit(margin)
    of = lambda f, c: f(F.transform(outer, lambda p: p[c]))
    return polygons.withColumns({"xmin": of(F.array_min, "lon") - m, "xmax": of(F.array_max, "lon") + m, "ymin": of(F.array_min, "lat") - m, "ymax": of(F.array_max, "lat") + m})


#: Cells grow by this factor from level to level, up to the whole globe.
GROWTH, LEVELS = 4, 9


def _candidates(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Points with the polygons whose box holds them.

    A polygon stands in the cells that its box touches, of a level whose cells are about as wide as the box, so that a
    country is as few rows as a house.  Points are placed at the levels that occur, nine at most.
    """
    span = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(size))
    levelled = polygons.withColumn("level", F.least(F.ceil(F.log(float(GROWTH), span / size) - 1e-9), F.lit(LEVELS - 1)).cast("int"))
    levels = sorted(r.level for r in levelled.where("level IS NOT NULL").select("level").distinct().collect())
    width = F.lit(size) * F.pow(F.lit(float(GROWTH)), F.col("level"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    placed = levelled.withColumn("gx", cells("xmin", "xmax")).withColumn("gy", cells("ymin", "ymax"))
    own = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    own = own.withColumns({"gx": F.floor(F.col("lon") / width), "gy": F.floor(F.col("lat") / width)})
    # Few bytes make much work here: tasks are set by number.
    own, placed = (df.repartition(tasks(points.sparkSession), "level", "gx", "gy") for df in (own, placed))
    pairs = own.join(placed, ["level", "gx", "gy"]).drop("level", "gx", "gy")
    return pairs.where(F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax")))


def containing(points: DataFrame, polygons: DataFrame, size: float = 0.01, keep_rings: bool = False) -> DataFrame:
    """Points (lon, lat) with each polygon (polygon_id, rings) that covers them; ``size`` is the least cell in degrees, about a small polygon's width."""
    pairs = _candidates(points, boxed(polygons), size)
    return pairs.where(covers(F.col("rings"), F.col("lon"), F.col("lat"))).drop(*([] if keep_rings else ["rings"]), "xmin", "xmax", "ymin", "ymax")


def ring_distance(rings: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to a polygon's boundary, in the plane around the point."""

    def away(e: Column) -> Column:
        (ax, ay), (bx, by) = (local_xy(e[s]["lon"], e[s]["lat"], lon, lat) for s in "ab")
        dx, dy = bx - ax, by - ay
        t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(edges(r), away))))


def plane(rings: Column, lon: Column, lat: Column) -> Column:
    """A polygon's rings as x/y structs in metres around a point."""

    def corner(p: Column) -> Column:
        x, y = local_xy(p["lon"], p["lat"], lon, lat)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, corner))


def _summed(ring: Column, of: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + of(e["a"], e["b"]))


def plane_area(rings: Column) -> Column:
    """Square metres of a polygon in a plane; rings after the first are holes."""
    of = lambda r: F.abs(_summed(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2
    return F.aggregate(rings, F.lit(0.0), lambda a, r: a - of(r)) + 2 * of(F.get(rings, F.lit(0)))


def plane_perimeter(rings: Column) -> Column:
    """Metres of all rings of a polygon in a plane."""
    of = lambda r: _summed(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(rings, F.lit(0.0), lambda a, r: a + of(r))


def touching(sites: DataFrame, polygons: DataFrame, metres: float, max_latitude: float = 15.0) -> DataFrame:
    """Each site once without, or with each polygon that comes within ``metres`` of it, and its distance (0 inside)."""
    size = geo.cell_size(metres, max_latitude)
    pairs = _candidates(geo.up_to_latitude(sites, "lat", max_latitude), boxed(polygons, size), max(size, 0.001))
    distance = F.when(covers(F.col("rings"), F.col("lon"), F.col("lat")), 0.0).otherwise(ring_distance(F.col("rings"), F.col("lon"), F.col("lat")))
    near = pairs.withColumn("distance", distance).where(F.col("distance") <= metres).select("site_id", "polygon_id", "rings", "distance")
    return sites.join(near, "site_id", "left")


def nearest_planar(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The nearest by degrees in the plane, as an index of geometries orders them, with the metres it is away; ties by ``ties``."""
    degrees = F.sqrt(F.pow(F.col("to_lon") - F.col("lon"), 2) + F.pow(F.col("to_lat") - F.col("lat"), 2))
    ranked = first_per(pairs.withColumn("__degrees", degrees), keys, [F.col("__degrees"), *[F.col(t) for t in ties]]).drop("__degrees")
    return ranked.withColumn("distance", geo.haversine(F.col("lon"), F.col("lat"), F.col("to_lon"), F.col("to_lat")))


def read_places(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Places of a Parquet map release whose own box begins within a box; the test is on the file's columns, so row groups outside are skipped."""
    b = F.col("bbox")
    return spark.read.parquet(path).where(b["xmin"].between(west, east) & b["ymin"].between(south, north))


def read_roads(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Roads of a Parquet map release whose box meets a box."""
    b = F.col("bbox")
    return spark.read.parquet(path).where((b["xmax"] >= west) & (b["xmin"] <= east) & (b["ymax"] >= south) & (b["ymin"] <= north))
