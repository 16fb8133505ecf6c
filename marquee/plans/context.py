"""Raster, settlement, network and streaming-window queries over made-up or given inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import raster, settlement, spatial
from marquee.plans.places import sites
from marquee.plans.warehouse import table
from marquee.streaming import windows


#: Rasters of the population queries: two grids of different cells over the same ground.
PEOPLE = raster.Grid((3.0, 0.01, 0.0, 7.2, 0.0, -0.01), 150, 120, 32, 32, -1.0)
WAYS = raster.Grid((2.95, 0.012, 0.0, 7.25, 0.0, -0.016), 131, 80, 16, 16)
#: Minutes a degree by mode, limits in minutes, and how far windows reach.
SPEEDS, MINUTES, SEARCH = {"walking": 400.0, "mixed": 210.0}, [5.0, 10.0, 20.0], 15_000.0


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers spread over a grid, of which every 17th cell has no data."""
    k = F.col("c_custkey")
    found = table(spark, sf, "customer").select(((k * 11) % PEOPLE.height).alias("row"), ((k * 7) % PEOPLE.width).alias("col"), (k % 40).alias("n")).groupBy("row", "col").agg(F.sum("n").alias("n"))
    cells = spark.range(PEOPLE.width * PEOPLE.height).select("id", F.floor(F.col("id") / PEOPLE.width).alias("row"), (F.col("id") % PEOPLE.width).alias("col"))
    value = F.when(F.col("id") % 17 == 0, F.lit(PEOPLE.nodata)).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
    return raster.tiled(cells.join(found, ["row", "col"], "left").select("row", "col", value.alias("value")), PEOPLE)


def _ways(spark: SparkSession) -> DataFrame:
    cells = spark.range(WAYS.width * WAYS.height).select(F.floor(F.col("id") / WAYS.width).alias("row"), (F.col("id") % WAYS.width).alias("col"))
    return raster.tiled(cells.select("row", "col", F.explode(F.create_map(*[F.lit(x) for pair in SPEEDS.items() for x in pair])).alias("mode", "value")), WAYS, ("mode",))


def _raster_sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.cast("string").alias("site_id"), (2.9537 + ((k * 37) % 1550) / 1000).alias("lon"), (6.0213 + ((k * 53) % 1190) / 1000).alias("lat"))


def accessible_population(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that suppliers' sites reach over even ground, in two modes."""
    found = raster.accessible_population(_raster_sites(spark, sf), _ways(spark), WAYS, _people(spark, sf), PEOPLE, list(SPEEDS), MINUTES, SEARCH)
    return found.withColumn("farthest_minutes", F.round("farthest_minutes", 6))


def population_rings(spark: SparkSession, sf: str) -> DataFrame:
    return raster.population_within(_raster_sites(spark, sf), _people(spark, sf), PEOPLE, [1000, 5000, 15000])


#: Sites, the points of the compass around them, and the windows of both rasters.
_WINDOWS = f"""
s AS (SELECT s_suppkey::VARCHAR AS site_id, 2.9537::DOUBLE + ((s_suppkey * 37) % 1550) / 1000 AS lon, 6.0213::DOUBLE + ((s_suppkey * 53) % 1190) / 1000 AS lat FROM supplier),
d AS (SELECT *, asin(sin(radians(lat)) * cos(w) + cos(radians(lat)) * sin(w) * cos(b)) AS q FROM (SELECT *, radians(unnest(range(0, 360, 45))) AS b, {SEARCH} / 6371008.8 AS w FROM s)),
ring AS (SELECT site_id, lon + degrees(atan2(sin(b) * sin(w) * cos(radians(lat)), cos(w) - sin(radians(lat)) * sin(q))) AS x, degrees(q) AS y FROM d),
w AS (SELECT site_id, floor(min((x - 3.0) / 0.01))::INT - 2 AS px0, ceil(max((x - 3.0) / 0.01))::INT + 2 AS px1, floor(min((7.2 - y) / 0.01))::INT - 2 AS py0, ceil(max((7.2 - y) / 0.01))::INT + 2 AS py1,
        floor(min((x - 2.95) / 0.012))::INT - 2 AS fx0, ceil(max((x - 2.95) / 0.012))::INT + 2 AS fx1, floor(min((7.25 - y) / 0.016))::INT - 2 AS fy0, ceil(max((7.25 - y) / 0.016))::INT + 2 AS fy1 FROM ring GROUP BY site_id),
v AS (SELECT s.*, greatest(px0, 0) AS px0, least(px1, 150) AS px1, greatest(py0, 0) AS py0, least(py1, 120) AS py1, greatest(fx0, 0) AS fx0, least(fx1, 131) AS fx1, greatest(fy0, 0) AS fy0, least(fy1, 80) AS fy1,
        px0 >= 0 AND py0 >= 0 AND px1 <= 150 AND py1 <= 120 AS covered, floor((lon - 2.95) / 0.012)::INT AS sx, floor((7.25 - lat) / 0.016)::INT AS sy FROM s JOIN w USING (site_id)),
n AS (SELECT (c_custkey * 11) % 120 AS r, (c_custkey * 7) % 150 AS c, sum(c_custkey % 40) AS n FROM customer GROUP BY ALL),
pop AS (SELECT i // 150 AS r, i % 150 AS c, CASE WHEN i % 17 <> 0 THEN coalesce(n, 0)::DOUBLE END AS v FROM range(18000) t(i) LEFT JOIN n ON n.r = i // 150 AND n.c = i % 150),
near AS (SELECT v.*, pop.r, pop.c, pop.v AS people FROM v JOIN pop ON pop.c >= px0 AND pop.c < px1 AND pop.r >= py0 AND pop.r < py1)
"""

# Over even ground the cheapest way goes aslant as far as it can and straight on from there; an aslant step is 0.02 degrees.
ACCESSIBLE_POPULATION = f"""
WITH {_WINDOWS},
m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SPEEDS.items())}) t(mode, speed)),
cells AS (SELECT site_id, mode, speed, x, y, x = fx0 OR x = fx1 - 1 OR y = fy0 OR y = fy1 - 1 AS edge, speed * (0.02 * least(abs(x - sx), abs(y - sy)) + 0.012 * greatest(abs(x - sx) - abs(y - sy), 0) + 0.016 * greatest(abs(y - sy) - abs(x - sx), 0)) AS cost
          FROM (SELECT *, unnest(range(fy0, fy1)) AS y FROM (SELECT *, unnest(range(fx0, fx1)) AS x FROM v)), m),
paid AS (SELECT * FROM cells WHERE cost <= {max(MINUTES)}),
lived AS (SELECT k.site_id, k.mode, people, paid.cost FROM (SELECT * FROM near, m) k LEFT JOIN paid ON paid.site_id = k.site_id AND paid.mode = k.mode AND paid.x = floor((3.0 + (c + 0.5) * 0.01 - 2.95) / 0.012) AND paid.y = floor((7.25 - (7.2 - (r + 0.5) * 0.01)) / 0.016)),
t AS (SELECT unnest({MINUTES})::DOUBLE AS minutes),
p AS (SELECT site_id, mode, minutes, coalesce(sum(people) FILTER (WHERE cost <= minutes), 0) AS population, count(*) AS n_candidates, count(people) AS n_valid, count(*) - count(people) AS n_nodata,
        count(people) FILTER (WHERE cost <= minutes) AS n_reachable, count(people) FILTER (WHERE cost IS NULL) AS n_unavailable FROM lived, t GROUP BY ALL),
f AS (SELECT site_id, mode, minutes, count(*) FILTER (WHERE cost <= minutes) AS n_friction_cells, round(max(cost) FILTER (WHERE cost <= minutes), 6) AS farthest_minutes, bool_or(edge) AS edge FROM paid, t GROUP BY ALL)
SELECT site_id, mode, minutes, population, n_candidates, n_valid, n_nodata, n_reachable, n_unavailable, n_friction_cells, farthest_minutes, CASE WHEN covered AND NOT edge THEN 'complete' ELSE 'partial_or_truncated' END AS status
FROM p JOIN f USING (site_id, mode, minutes) JOIN v USING (site_id)
"""

POPULATION_RINGS = f"""
WITH {_WINDOWS},
k AS (SELECT site_id, people, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - (7.2 - (r + 0.5) * 0.01)) / 2), 2) + cos(radians(7.2 - (r + 0.5) * 0.01)) * cos(radians(lat)) * pow(sin(radians(lon - (3.0 + (c + 0.5) * 0.01)) / 2), 2)))) AS away FROM near)
SELECT v.site_id, radius, coalesce(sum(people) FILTER (WHERE away <= radius), 0) AS population, count(*) FILTER (WHERE away <= radius) AS n_candidates, count(people) FILTER (WHERE away <= radius) AS n_valid,
  count(*) FILTER (WHERE away <= radius AND people IS NULL) AS n_nodata, CASE WHEN any_value(covered) THEN 'complete' ELSE 'partial_source_coverage' END AS status
FROM v LEFT JOIN k USING (site_id), (SELECT unnest([1000, 5000, 15000]) AS radius) GROUP BY ALL
"""


#: Sites of the settlement query stand on a lattice of so many columns and rows, STEP degrees apart.
COLUMNS, ROWS, STEP = 200, 230, 0.06
#: Three squares by the place of their centre and half their side, in degrees times a size that varies by site.
SQUARES = (("a", 0.0, 0.0, 0.002), ("b", 0.003, 0.001, 0.002), ("c", -0.006, 0.0, 0.001))


def settlement_context(spark: SparkSession, sf: str) -> DataFrame:
    """Square settlements of three sizes, a few for each supplier; all lie in one table and are found by the sites' circles."""
    k = F.col("s_suppkey")
    lon, lat = 3.0 + (k % COLUMNS) * STEP, 0.5 + (F.floor(k / COLUMNS) % ROWS) * STEP
    placed = table(spark, sf, "supplier").select(k.cast("string").alias("site_id"), lon.alias("lon"), lat.alias("lat"), (1 + (k % 5) * 0.1).alias("size"))
    square = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(h).alias("h")) for n, x, y, h in SQUARES]))
    drawn = placed.select("site_id", "lon", "lat", "size", square)
    corner = lambda a, b: F.struct((F.col("lon") + F.col("size") * (F.col("dx") + a * F.col("h"))).alias("lon"), (F.col("lat") + F.col("size") * (F.col("dy") + b * F.col("h"))).alias("lat"))
    extents = drawn.select(F.concat_ws(":", "site_id", "name").alias("polygon_id"), F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))
    box = lambda *c: F.array(F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in c]))
    coverage = spark.range(1).select(F.lit("whole").alias("polygon_id"), box((2.0, 0.485), (20.0, 0.485), (20.0, 15.0), (2.0, 15.0)).alias("rings"))
    found = settlement.context(placed.drop("size"), extents, coverage, [1200, 2000], 1000.0)
    metres = ("circle_m2", "settled_m2", "largest_m2", "area_m2", "perimeter_m", "core_depth_m", "nearest_m")
    shares = ("settled_share", "parts_per_km2", "largest_share", "compactness")
    return found.select(
        "site_id", "radius", "n_extents", "n_parts", "source_covered", "coverage_status", "inside", "n_containing", "primary_id", *[F.round(c, 2).alias(c) for c in metres], *[F.round(c, 6).alias(c) for c in shares]
    )


SETTLEMENT_CONTEXT = f"""
WITH s AS (SELECT s_suppkey AS k, 0.5 + ((s_suppkey // {COLUMNS}) % {ROWS}) * {STEP} AS lat, (s_suppkey % {COLUMNS})::VARCHAR || ':' || ((s_suppkey // {COLUMNS}) % {ROWS})::VARCHAR AS place,
        1 + (s_suppkey % 5) * 0.1::DOUBLE AS size FROM supplier),
m AS (SELECT *, pi() / 180 * 6378137.0 / sqrt(w) * cos(radians(lat)) AS kx, pi() / 180 * 6378137.0 * (1 - 0.00669437999014) / pow(w, 1.5) AS ky
      FROM (SELECT *, 1 - 0.00669437999014 * pow(sin(radians(lat)), 2) AS w FROM s)),
p AS (SELECT place, count(*) AS n, min(k::VARCHAR || ':a') AS primary_id FROM s GROUP BY place),
-- Squares a and b overlap in 1 by 3 thousandths of a degree; c lies apart.
c AS (SELECT m.*, p.n, p.primary_id, r.radius, 33e-6 * size * size * kx * ky AS settled, 29e-6 * size * size * kx * ky AS largest, 16e-6 * size * size * kx * ky AS area,
        0.008 * size * (kx + ky) AS perimeter, 16 * r.radius * r.radius * sin(pi() / 16) AS circle
      FROM m JOIN p USING (place), (SELECT unnest([1200, 2000]) AS radius) r)
SELECT k::VARCHAR AS site_id, radius, (3 * n)::INT AS n_extents, 2 AS n_parts, (lat - 0.485) * ky >= radius * cos(pi() / 32) AS source_covered,
  CASE WHEN (lat - 0.485) * ky >= radius * cos(pi() / 32) THEN 'complete' ELSE 'partial_source_coverage' END AS coverage_status, true AS inside, n::INT AS n_containing, primary_id,
  round(circle, 2) AS circle_m2, round(settled, 2) AS settled_m2, round(largest, 2) AS largest_m2, round(area, 2) AS area_m2, round(perimeter, 2) AS perimeter_m,
  round(0.002 * size * least(kx, ky), 2) AS core_depth_m, 0.0::DOUBLE AS nearest_m, round(settled / circle, 6) AS settled_share, round(2 / (circle / 1000000), 6) AS parts_per_km2,
  round(largest / settled, 6) AS largest_share, round(4 * pi() * area / (perimeter * perimeter), 6) AS compactness
FROM c
"""


CIRCLES = ("site_id", "radius", "n_extents", "n_parts", "settled_m2", "largest_m2", "settled_share", "largest_share")


def settlement_morphology(spark: SparkSession, sf: str) -> DataFrame:
    """The settled ground within the circles alone."""
    return settlement_context(spark, sf).select(*CIRCLES)


SETTLEMENT_MORPHOLOGY = f"SELECT {', '.join(CIRCLES)} FROM ({SETTLEMENT_CONTEXT})"


def network_context(spark: SparkSession, sf: str) -> DataFrame:
    """Straight made-up roads, one per part, around the suppliers' sites."""
    k = F.col("p_partkey")
    at = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    lon, lat = F.lit(3.30) + ((k * 613) % 1000) / 10000, F.lit(6.45) + ((k * 821) % 1000) / 10000
    roads = table(spark, sf, "part").select(
        F.concat(F.lit("road:"), k.cast("string")).alias("road_id"), F.element_at(F.array(*[F.lit(c) for c in ("residential", "primary", "secondary", "tertiary")]), (F.floor(k / 4) % 4 + 1).cast("int")).alias("road_class"),
        F.array(k % 97, k % 89 + 100).alias("connectors"), F.array(at(lon, lat), at(lon + 0.004, lat + 0.002), at(lon + 0.004, lat + 0.006)).alias("path"),
    )
    found = spatial.network_context(sites(spark, sf).select(F.col("s_suppkey").cast("string").alias("site_id"), "lon", "lat"), roads, [500, 1000])
    return found.select("site_id", "radius", "n_roads", "n_major", "n_connectors", *[F.round(c, 3).alias(c) for c in ("length_m", "major_length_m", "density_km_per_km2", "nearest_road_m", "nearest_major_m")], "nearest_road", "nearest_major")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.window_counts(events).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


EVENT_WINDOWS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*)::BIGINT AS n_events, round(sum(value::DECIMAL(18, 4))::DOUBLE, 4) AS total FROM events GROUP BY ALL"

ENTRIES = {
    "accessible_population": (accessible_population, ACCESSIBLE_POPULATION),
    "population_rings": (population_rings, POPULATION_RINGS),
    "settlement_context": (settlement_context, SETTLEMENT_CONTEXT),
    "settlement_morphology": (settlement_morphology, SETTLEMENT_MORPHOLOGY),
    "network_context": (network_context, None),
    "event_windows": (event_windows, EVENT_WINDOWS),
}
