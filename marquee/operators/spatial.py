"""Joins and aggregates by distance.

Points meet through grid cells as wide as the largest distance, one side spread
over its nine neighbouring cells, so that a join by distance is an equi-join on
the cell followed by the exact test.  Several radii are served by one such join at
the largest radius.

Rows that share a position have the same distances, so callers measure positions
(``positions``, with the places of a position added up beforehand) and hand what
was found to every row there (``for_each``): the number of pairs follows from the
positions, however many rows stand at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import geo
from marquee.operators.heads import first_per


def within(left: DataFrame, right: DataFrame, metres: float, max_latitude: float = 15.0) -> DataFrame:
    """Pairs at most ``metres`` apart, with their ``distance``; ``left`` has lon and lat, ``right`` has to_lon and to_lat.

    Cells are sized for ``max_latitude``; a row of ``left`` beyond it is an error.
    """
    size = geo.cell_size(metres, max_latitude)
    left = geo.up_to_latitude(left, "lat", max_latitude)
    near = geo.near_cells(left, "lon", "lat", size)
    own = geo.in_own_cell(right, "to_lon", "to_lat", size)
    pairs = near.join(own, ["gx", "gy"]).drop("gx", "gy")
    return pairs.withColumn("distance", geo.haversine(F.col("lon"), F.col("lat"), F.col("to_lon"), F.col("to_lat"))).where(F.col("distance") <= metres)


def positions(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The distinct positions of rows."""
    return rows.select(lon, lat).distinct()


def tasks(spark: SparkSession) -> int:
    """The number of tasks for a step whose work its input's size does not show, so that Spark would join them to few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def for_each(sites: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for positions (lon, lat), for each site there.

    If that is many rows a position, sites of a position are dealt to several tasks, each with a copy of the position's
    rows; there are no more copies than sites at a position on average.
    """
    n, places = sites.agg(F.count(F.lit(1)), F.countDistinct("lon", "lat")).first()
    copies = max(1, min(COPIES, n // max(places, 1)))
    parts = tasks(sites.sparkSession)
    dealt = sites.withColumn("__copy", (F.monotonically_increasing_id() % copies).cast("int")).repartition(parts, "lon", "lat", "__copy")
    copied = found.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(parts, "lon", "lat", "__copy")
    return dealt.join(copied, ["lon", "lat", "__copy"]).drop("__copy")


#: The most tasks that the sites of one position are dealt to.
COPIES = 16


def by_radius(pairs: DataFrame, radii: list[int]) -> DataFrame:
    """Each pair once for every radius that reaches it."""
    return pairs.withColumn("radius", F.explode(F.filter(F.array(*[F.lit(r) for r in sorted(set(radii))]), lambda r: F.col("distance") <= r)))


def radius_summary(sites: DataFrame, pairs: DataFrame, radii: list[int], key: str, counts: dict[str, Column], covered: Column | None = None, at: list[str] | None = None) -> DataFrame:
    """Counts per site and radius; covered radii without a hit give zeros, uncovered ones give no row.

    ``at``: the columns of ``sites`` that ``pairs`` are by, if not by the key.
    """
    at = at or [key]
    every = sites.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in sorted(set(radii))])))
    if covered is not None:
        every = every.where(covered)
    found = by_radius(pairs, radii).groupBy(*at, "radius").agg(*[c.alias(n) for n, c in counts.items()])
    return every.join(found, [*at, "radius"], "left").select(key, "radius", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts])


def count_map(rows: DataFrame, keys: list[str], category: str, count: Column | None = None) -> DataFrame:
    """A map of category to count per key, in order of the category; ``count`` is the number that a row stands for."""
    n = rows.groupBy(*keys, category).agg(F.sum(F.lit(1) if count is None else count).alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category).alias("k"), F.col("n").alias("v"))))).alias("counts"))


def entropy(rows: DataFrame, keys: list[str], category: str, count: Column | None = None) -> DataFrame:
    """Shannon entropy (nats) of the known categories per key; ``count`` is the number that a row stands for."""
    n = rows.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.sum(F.lit(1) if count is None else count).cast("double").alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    return n.groupBy(*keys).agg((F.log(total) - weighted / total).alias("entropy"), F.count(F.lit(1)).alias("n_categories"))


def nearest(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    return first_per(pairs, keys, [F.col("distance"), *[F.col(t) for t in ties]])


#: Local plane around a site: metres per degree on the ellipsoid (WGS84).
_A, _E2 = 6_378_137.0, 0.00669437999014


def local_xy(lon: Column, lat: Column, at_lon: Column, at_lat: Column) -> tuple[Column, Column]:
    """East and north metres of a point from a site, good to about a millionth within a few kilometres."""
    s = F.sin(F.radians(at_lat))
    w = 1 - _E2 * s * s
    east = F.radians(lon - at_lon) * _A / F.sqrt(w) * F.cos(F.radians(at_lat))
    north = F.radians(lat - at_lat) * _A * (1 - _E2) / F.pow(w, F.lit(1.5))
    return east, north


def segments(lines: DataFrame, path: str = "path") -> DataFrame:
    """One row per pair of consecutive points of a line of lon/lat structs."""
    pairs = F.filter(F.transform(path, lambda p, i: F.struct(p.alias("a"), F.get(path, i + 1).alias("b"))), lambda s: s["b"].isNotNull())
    return lines.withColumn("__s", F.explode(pairs)).select(*[c for c in lines.columns if c != path], F.col("__s.a.lon").alias("a_lon"), F.col("__s.a.lat").alias("a_lat"), F.col("__s.b.lon").alias("b_lon"), F.col("__s.b.lat").alias("b_lat"))


def segment_measures(pairs: DataFrame) -> DataFrame:
    """For rows of a site (lon, lat, radius) and a segment: distance, and length within the circle of ``radius``."""
    ax, ay = local_xy(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    bx, by = local_xy(F.col("b_lon"), F.col("b_lat"), F.col("lon"), F.col("lat"))
    df = pairs.withColumns({"__ax": ax, "__ay": ay, "__dx": bx - ax, "__dy": by - ay})
    dd = F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")
    dot = F.col("__ax") * F.col("__dx") + F.col("__ay") * F.col("__dy")
    df = df.withColumns({"__dd": dd, "__dot": dot})
    at = F.when(F.col("__dd") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("__dot") / F.col("__dd")))).otherwise(0.0)
    df = df.withColumn("__t", at)
    px, py = F.col("__ax") + F.col("__t") * F.col("__dx"), F.col("__ay") + F.col("__t") * F.col("__dy")
    radius = F.col("radius").cast("double")
    root = F.col("__dot") * F.col("__dot") - F.col("__dd") * (F.col("__ax") * F.col("__ax") + F.col("__ay") * F.col("__ay") - radius * radius)
    low = F.greatest(F.lit(0.0), (-F.col("__dot") - F.sqrt(root)) / F.col("__dd"))
    high = F.least(F.lit(1.0), (-F.col("__dot") + F.sqrt(root)) / F.col("__dd"))
    inside = F.when((F.col("__dd") > 0) & (root > 0), F.greatest(F.lit(0.0), high - low) * F.sqrt("__dd")).otherwise(0.0)
    return df.withColumns({"distance": F.sqrt(px * px + py * py), "length_m": inside}).drop("__ax", "__ay", "__dx", "__dy", "__dd", "__dot", "__t")


#: Road classes that count as major.
MAJOR_ROADS = ("motorway", "trunk", "primary", "secondary")


def network_context(sites: DataFrame, roads: DataFrame, radii: list[int], max_latitude: float = 15.0) -> DataFrame:
    """Per site and radius: roads, connectors, lengths by class, density, and the nearest road and major road.

    ``sites``: site_id, lon, lat; one beyond ``max_latitude``, for which cells are sized, is an error.  ``roads``: road_id, road_class, connectors, path.
    Rows of one road_id and class are one road, with the segments and connectors of all of them.  Roads of one course are
    measured once, and sites at one position as well.
    """
    top = float(max(radii))
    size = geo.cell_size(top, max_latitude)
    spots = positions(geo.up_to_latitude(sites, "lat", max_latitude))
    each_radius = F.explode(F.array(*[F.lit(r) for r in sorted(set(radii))]))
    # A road's course is its distinct segments in order; a line without a segment is never met.
    pairs_of = F.filter(F.transform("path", lambda p, i: F.struct(p["lon"].alias("a_lon"), p["lat"].alias("a_lat"), F.get("path", i + 1)["lon"].alias("b_lon"), F.get("path", i + 1)["lat"].alias("b_lat"), (i + 1 < F.size("path")).alias("more"))), lambda s: s["more"])
    parts = tasks(sites.sparkSession)
    whole = roads.repartition(parts, "road_id", "road_class").select("road_id", "road_class", "connectors", pairs_of.alias("s")).groupBy("road_id", "road_class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("course"), F.flatten(F.collect_list("connectors")).alias("connectors"))
    whole = whole.withColumn("course_id", F.sha2(F.to_json("course"), 256))
    classes = whole.groupBy("course_id", "road_class").agg(F.count(F.lit(1)).alias("n"), F.min("road_id").alias("road_id"), F.any_value("course").alias("course"))
    # One row a course, with as many entries as there are classes.
    courses = classes.groupBy("course_id").agg(F.any_value("course").alias("course"), F.collect_list(F.struct("road_class", "n", "road_id")).alias("roads"))
    seg = courses.select("course_id", F.inline("course")).drop("more")
    # A segment stands in every cell that its box touches.
    span = lambda a, b: F.sequence(geo.cell(F.least(a, b), size), geo.cell(F.greatest(a, b), size))
    placed = seg.withColumn("gx", F.explode(span(F.col("a_lon"), F.col("b_lon")))).withColumn("gy", F.explode(span(F.col("a_lat"), F.col("b_lat"))))
    pairs = geo.near_cells(spots, "lon", "lat", size).join(placed, ["gx", "gy"]).drop("gx", "gy").distinct()
    hits = segment_measures(pairs.withColumn("radius", each_radius)).where(F.col("distance") <= F.col("radius"))
    met = hits.groupBy("lon", "lat", "radius", "course_id").agg(F.min("distance").alias("distance"), F.sum("length_m").alias("length_m"))
    lines = met.join(courses.select("course_id", "roads"), "course_id").select("lon", "lat", "radius", "distance", "length_m", F.inline("roads"))
    major = F.col("road_class").isin(*MAJOR_ROADS)
    least = lambda c: F.min(F.when(c, F.struct("distance", "road_id")))
    total = F.col("n") * F.col("length_m")
    summary = lines.groupBy("lon", "lat", "radius").agg(
        F.sum("n").alias("n_roads"), F.sum(F.when(major, F.col("n")).otherwise(0)).alias("n_major"), F.sum(total).alias("length_m"), F.sum(F.when(major, total).otherwise(0.0)).alias("major_length_m"),
        least(F.lit(True)).alias("__n"), least(major).alias("__m"),
    )
    # A connector counts from the least radius that holds one of its roads.  Few rows come in and many go out: tasks are set by number.
    joints = whole.select("course_id", F.explode("connectors").alias("c")).where("c IS NOT NULL").distinct()
    nearest_met = met.groupBy("lon", "lat", "course_id").agg(F.min("radius").alias("least"))
    reached = nearest_met.repartition(parts, "course_id").join(joints.repartition(parts, "course_id"), "course_id").groupBy("lon", "lat", "c").agg(F.min("least").alias("least"))
    counted = reached.groupBy("lon", "lat", "least").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.withColumn("radius", each_radius).where("radius >= least").groupBy("lon", "lat", "radius").agg(F.sum("n").alias("n_connectors"))
    every = sites.select("site_id", "lon", "lat").withColumn("radius", each_radius)
    out = every.join(summary.join(joined, ["lon", "lat", "radius"], "left"), ["lon", "lat", "radius"], "left")
    import math

    length = F.coalesce("length_m", F.lit(0.0))
    return out.select(
        "site_id", "radius", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_roads", "n_major", "n_connectors")], length.alias("length_m"), F.coalesce("major_length_m", F.lit(0.0)).alias("major_length_m"),
        (length * 1000 / (math.pi * F.col("radius") * F.col("radius"))).alias("density_km_per_km2"), F.col("__n.road_id").alias("nearest_road"), F.col("__n.distance").alias("nearest_road_m"), F.col("__m.road_id").alias("nearest_major"), F.col("__m.distance").alias("nearest_major_m"),
    )


def population_within(sites: DataFrame, cells: DataFrame, radii: list[int]) -> DataFrame:
    """Population sums over raster cells whose centres are within each radius, with valid and nodata cells."""
    centres = cells.groupBy(F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")).agg(F.sum("value").alias("p"), F.count("value").alias("v"), F.count_if(F.col("value").isNull()).alias("n"))
    pairs = within(positions(sites), centres, float(max(radii)))
    found = by_radius(pairs, radii).groupBy("lon", "lat", "radius").agg(F.sum("p").alias("population"), F.sum("v").alias("n_valid"), F.sum("n").alias("n_nodata"))
    every = sites.select("site_id", "lon", "lat").withColumn("radius", F.explode(F.array(*[F.lit(r) for r in sorted(set(radii))])))
    return every.join(found, ["lon", "lat", "radius"], "left").select("site_id", "radius", "population", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_nodata", F.lit(0)).alias("n_nodata"))
