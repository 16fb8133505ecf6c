"""Settlement context of sites: the extents that contain a site, and the settled ground within circles around it.

Extents are found by a join on cells (``polygons``), measured in the plane around each site, and overlaid tile by tile
(``overlay``), so neither an extent nor a circle is ever the work of one task.  Sites at one position and extents of one
shape are measured once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import stats
from marquee.operators import overlay, polygons


def near_extents(sites: DataFrame, extents: DataFrame, metres: float, max_latitude: float = 15.0) -> DataFrame:
    """Sites (site_id, lon, lat) with each extent (polygon_id, rings) within ``metres``, its distance and its rings in metres."""
    found = polygons.touching(sites, extents, metres, max_latitude).where(F.col("polygon_id").isNotNull())
    return found.select("site_id", "lon", "lat", "polygon_id", "rings", "distance", polygons.plane(F.col("rings"), F.col("lon"), F.col("lat")).alias("plane"))


def shapes(extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes of extents: polygon_id (a hash of the rings), rings, n_rows and the least id of an extent of this shape;
    and ids by what shapes they have: class, n_extents (how many ids have just these shapes) and polygon_id (each of them)."""
    hashed = extents.where("polygon_id IS NOT NULL").select(F.col("polygon_id").cast("string").alias("name"), F.sha2(F.to_json("rings"), 256).alias("polygon_id"), "rings")
    drawn = hashed.groupBy("polygon_id").agg(F.any_value("rings").alias("rings"), F.count(F.lit(1)).alias("n_rows"), F.min("name").alias("first_id"))
    owned = hashed.groupBy("name").agg(F.array_sort(F.collect_set("polygon_id")).alias("of"))
    classes = owned.groupBy("of").agg(F.count(F.lit(1)).alias("n_extents"))
    return drawn, classes.select(F.sha2(F.array_join("of", ","), 256).alias("class"), "n_extents", F.explode("of").alias("polygon_id"))


def within_circles(sites: DataFrame, near: DataFrame, radii: list[int], classes: DataFrame) -> DataFrame:
    """A row for each site and radius: extents met, settled ground, its parts, and their shares of the circle and of the whole."""
    circles = overlay.union_within(near, radii)
    # An extent of several shapes counts once.
    met = circles.select("site_id", "radius", F.explode("met").alias("polygon_id")).join(classes, "polygon_id").select("site_id", "radius", "class", "n_extents").distinct()
    counted = met.groupBy("site_id", "radius").agg(F.sum("n_extents").cast("int").alias("n_extents"))
    measured = circles.drop("n_extents", "met").join(counted, ["site_id", "radius"], "left")
    every = sites.select("site_id", F.explode(F.array(*[F.lit(r) for r in radii]).cast("array<int>")).alias("radius"))
    whole = overlay.circle_area(F.col("radius"))
    settled = F.coalesce("settled_m2", F.lit(0.0))
    largest = F.coalesce("largest_m2", F.lit(0.0))
    return every.join(measured, ["site_id", "radius"], "left").select(
        "site_id", "radius", whole.alias("circle_m2"), F.coalesce("n_extents", F.lit(0)).alias("n_extents"), settled.alias("settled_m2"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"),
        largest.alias("largest_m2"), F.least(F.lit(1.0), settled / whole).alias("settled_share"), (F.coalesce("n_parts", F.lit(0)) / (whole / 1_000_000)).alias("parts_per_km2"),
        F.when(settled > 0, F.least(F.lit(1.0), largest / settled)).alias("largest_share"),
    )


def primary_extents(sites: DataFrame, near: DataFrame) -> DataFrame:
    """A row for each site: how many extents contain it, the smallest of them (ties by id) with its form, and the nearest extent.

    ``core_depth_m`` is how far inside the primary extent the site lies; ``nearest_m`` is 0 inside, and null if no extent
    is as near as ``near`` reaches.
    """
    plane, own = F.col("plane"), F.col("distance") == 0
    area, perimeter = polygons.plane_area(plane), polygons.plane_perimeter(plane)
    depth = polygons.ring_distance(F.col("rings"), F.col("lon"), F.col("lat"))
    form = F.struct(area.alias("area_m2"), F.col("first_id").alias("primary_id"), perimeter.alias("perimeter_m"), depth.alias("core_depth_m"))
    each = near.select("site_id", "distance", F.when(own, F.col("n_rows")).alias("n"), F.when(own, form).alias("form"))
    found = each.groupBy("site_id").agg(F.min("distance").alias("nearest_m"), F.sum("n").cast("int").alias("n_containing"), F.min("form").alias("form"))
    joined = sites.select("site_id").join(found, "site_id", "left").select("site_id", F.coalesce("n_containing", F.lit(0)).alias("n_containing"), "form.*", "nearest_m")
    compactness = stats.compactness(F.col("area_m2"), F.col("perimeter_m")).alias("compactness")
    return joined.select("site_id", F.col("primary_id").isNotNull().alias("inside"), "n_containing", "primary_id", "area_m2", "perimeter_m", compactness, "core_depth_m", "nearest_m")


def covered(sites: DataFrame, coverage: DataFrame, radii: list[int], max_latitude: float = 15.0) -> DataFrame:
    """Per site and radius whether the whole circle lies in one of the source's coverage polygons (polygon_id, rings)."""
    held = polygons.containing(sites.select("site_id", "lon", "lat"), coverage, keep_rings=True)
    margin = held.groupBy("site_id").agg(F.max(polygons.ring_distance(F.col("rings"), F.col("lon"), F.col("lat"))).alias("margin"))
    every = sites.select("site_id", F.explode(F.array(*[F.lit(r) for r in radii]).cast("array<int>")).alias("radius")).join(margin, "site_id", "left")
    return every.select("site_id", "radius", F.coalesce(F.col("margin") >= F.col("radius") * math.cos(math.pi / overlay.CORNERS), F.lit(False)).alias("source_covered"))


def context(sites: DataFrame, extents: DataFrame, coverage: DataFrame, radii: list[int], search: float, max_latitude: float = 15.0) -> DataFrame:
    """One row a site and radius with all of the above; a circle beyond the coverage is ``partial_source_coverage``."""
    at = F.concat_ws(",", F.coalesce(F.col("lon").cast("string"), F.lit("-")), F.coalesce(F.col("lat").cast("string"), F.lit("-")))
    placed = sites.select(F.col("site_id").alias("own_id"), at.alias("site_id"), "lon", "lat")
    spots = placed.select("site_id", "lon", "lat").dropDuplicates(["site_id"])
    drawn, classes = shapes(extents)
    near = near_extents(spots, drawn, max([float(r) for r in radii] + [search]), max_latitude)
    named = near.join(drawn.select("polygon_id", "n_rows", "first_id"), "polygon_id")
    found = within_circles(spots, near, radii, classes).join(covered(spots, coverage, radii, max_latitude), ["site_id", "radius"]).join(primary_extents(spots, named), "site_id")
    each = placed.select("own_id", "site_id").join(found, "site_id").drop("site_id").withColumnRenamed("own_id", "site_id")
    return each.withColumn("coverage_status", F.when(F.col("source_covered"), "complete").otherwise("partial_source_coverage"))
