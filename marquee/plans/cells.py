"""Sheet cells, resolved sites and airports, ratings, raster sums and measures over the given tables, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import geo, ids, stats, text
from marquee.operators import parse, spatial, survey
from marquee.plans.places import PLACES_SQL, places, sites
from marquee.plans.rules import listed, pick
from marquee.plans.warehouse import table

NUMBERS = (" 1,234.5 ", "45%", "-", "n/a", "7", "1e3", "", "3.5 kg", "-2", ".5")
PERIODS = ("January", "feb/March", "Q1", "", "march / april", " MAY ", "June/")


def parsed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, texts and periods in cells as people type them."""
    k = F.col("p_partkey")
    number, label = pick(NUMBERS, k), pick(PERIODS, k)
    period = text.source_period(label)
    return table(spark, sf, "part").select(
        "p_partkey", text.loose_number(number).alias("number"), text.loose_integer(number).cast("double").alias("whole"), text.source_text(F.concat(F.lit("  a \t"), number)).alias("shown"), text.normalized_text(label).alias("plain"), period["kind"].alias("kind"),
        F.array_join(F.transform(period["months"], lambda m: m.cast("string")), ",").alias("months"), text.single_month(period).cast("double").alias("month"), text.natural_key(F.col("p_brand"), label, F.lit(2024)).alias("natural_key"), text.slug(F.col("p_brand")).alias("slug"),
    )


PARSED_CELLS = f"""
WITH p AS (SELECT p_partkey, p_brand, p_partkey % 10 AS i, p_partkey % 7 AS j, {listed(NUMBERS)}[p_partkey % 10 + 1] AS n, {listed(PERIODS)}[p_partkey % 7 + 1] AS l FROM part)
SELECT p_partkey, [1234.5, 45, NULL, NULL, 7, 1000, NULL, NULL, -2, 0.5][i + 1]::DOUBLE AS number, [NULL, 45, NULL, NULL, 7, 1000, NULL, NULL, -2, NULL][i + 1]::DOUBLE AS whole, 'a' || CASE WHEN trim(n) = '' THEN '' ELSE ' ' || trim(n) END AS shown,
  lower(regexp_replace(trim(l), ' +', ' ', 'g')) AS plain, ['month', 'unparsed', 'unparsed', 'quarter_only', 'combined', 'month', 'unparsed'][j + 1] AS kind, ['1', '', '', '', '3,4', '5', ''][j + 1] AS months, [1, NULL, NULL, NULL, NULL, 5, NULL][j + 1]::DOUBLE AS month,
  lower(p_brand) || '|' || lower(regexp_replace(trim(l), ' +', ' ', 'g')) || '|2024' AS natural_key, replace(lower(p_brand), '#', '_') AS slug FROM p
"""


def resolved_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as observations of sites with a strict key of five parts: sites with their first row, and how many rows go to review."""
    k = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("State "), k % 5).alias("state"), F.when(k % 7 != 0, F.concat(F.lit("CITY-"), k % 9)).otherwise(" . ").alias("city"), F.concat(k.cast("string"), F.lit(" Road,")).alias("address"), F.col("l_returnflag").alias("board_type"), F.col("l_linestatus").alias("format"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    good, review = parse.site_entities(parse.first_spellings(rows, order))
    one = parse.representative_sites(good, [F.col(c) for c in order], "n_seen")
    kept = one.select("site_id", "city", F.col("l_orderkey").cast("double").alias("first_order"), "n_rows")
    return kept.unionByName(review.groupBy("city").agg(F.sum("n_seen").alias("n_rows")).select(F.lit(None).cast("string").alias("site_id"), "city", F.lit(None).cast("double").alias("first_order"), "n_rows"))


RESOLVED_SITES = f"""
WITH l AS (SELECT 'state ' || (l_suppkey % 5) || '|city ' || (l_suppkey % 9) || '|' || l_suppkey || ' road|' || lower(l_returnflag) || '|' || lower(l_linestatus) AS key, CASE WHEN l_suppkey % 7 <> 0 THEN 'CITY-' || (l_suppkey % 9) ELSE ' . ' END AS city, l_suppkey % 7 <> 0 AS ok, l_orderkey FROM lineitem)
SELECT 'site:' || substr(sha256('["{ids.RESOLVER}","' || key || '"]'), 1, 32) AS site_id, min(city) AS city, min(l_orderkey)::DOUBLE AS first_order, count(*)::BIGINT AS n_rows FROM l WHERE ok GROUP BY key
UNION ALL SELECT NULL, city, NULL, count(*) FROM l WHERE NOT ok GROUP BY city
"""


def resolved_airports(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' labels as airports: by name, by alias, by the only airport of the state, or for review."""
    k = F.col("c_custkey")
    names = table(spark, sf, "customer").select(pick(("Murtala Int'l", "los", "KANO airport", "Somewhere", "???"), k).alias("label"), F.concat(F.lit("S"), k % 6).alias("state"))
    entries = [("murtala int l", "LOS", 0), ("los", "LOS", 1), ("kano airport", "KAN", 1), ("kano airport", "KAD", 1)]
    aliases = spark.createDataFrame(entries, "key string, airport string, rank int")
    anchors = spark.createDataFrame([("S0", "AAA"), ("S1", None), ("S2", "CCC")], "state string, airport string")
    return parse.airport_links(names, aliases, anchors).groupBy("label", "state", "airport", "method").agg(F.count(F.lit(1)).alias("n_rows"))


RESOLVED_AIRPORTS = """
WITH c AS (SELECT ['Murtala Int''l', 'los', 'KANO airport', 'Somewhere', '???'][c_custkey % 5 + 1] AS label, c_custkey % 5 AS i, c_custkey % 6 AS s FROM customer)
SELECT label, 'S' || s AS state, CASE WHEN i <= 1 THEN 'LOS' WHEN i = 2 THEN 'KAD' WHEN s = 0 THEN 'AAA' WHEN s = 2 THEN 'CCC' END AS airport, CASE WHEN i = 0 THEN 'exact_name' WHEN i <= 2 THEN 'alias' WHEN s IN (0, 2) THEN 'state_anchor' ELSE 'review' END AS method, count(*)::BIGINT AS n_rows FROM c GROUP BY ALL
"""


def rating_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Five formats by five qualities, rated by the customers."""
    k = F.col("c_custkey")
    cells = [F.struct(F.lit(f"f{a}").alias("row"), F.lit(f"q{b}").alias("column"), F.when((k + 3 * a + b) % 11 != 0, ((k * (a + 1) + b) % 5 + 1).cast("double")).alias("rating")) for a in range(5) for b in range(5)]
    return survey.rating_matrix(table(spark, sf, "customer").select(F.array(*cells).alias("ratings")), "ratings")


RATING_MATRIX = """
WITH c AS (SELECT c_custkey AS k, a, b, CASE WHEN (c_custkey + 3 * a + b) % 11 <> 0 THEN ((c_custkey * (a + 1) + b) % 5 + 1)::DOUBLE END AS r FROM customer, (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b)),
m AS (SELECT 'f' || a AS row, 'q' || b AS col, count(r) AS n, avg(r) AS m FROM c GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*), avg(x) FROM (SELECT k, avg(r) AS x FROM c GROUP BY k HAVING count(r) = 25))
SELECT row, col AS "column", n::BIGINT AS n, CASE WHEN n >= 30 THEN floor(m * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE END AS mean FROM m
"""


def population_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' places as raster cells around the suppliers' sites; negative balances are cells without data."""
    cells = places(spark, sf).select(F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"))
    found = spatial.population_within(sites(spark, sf).select(F.col("s_suppkey").alias("site_id"), "lon", "lat"), cells, [500, 2000])
    return found.select("site_id", F.col("radius").cast("long").alias("radius"), F.round("population", 3).alias("population"), "n_valid", "n_nodata")


POPULATION_RADIUS = f"""
WITH {PLACES_SQL}, r AS (SELECT unnest([500, 2000]) AS radius)
SELECT s.s_suppkey AS site_id, radius::BIGINT AS radius, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 3) AS population, count(CASE WHEN c_acctbal >= 0 THEN 1 END)::BIGINT AS n_valid, count(CASE WHEN c_acctbal < 0 THEN 1 END)::BIGINT AS n_nodata
FROM s CROSS JOIN r LEFT JOIN pairs p ON p.s_suppkey = s.s_suppkey AND p.distance <= radius GROUP BY ALL
"""


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Compactness, direction of change, a way along a great circle, and its length."""
    k, q, p = F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice")
    lon, lat, bearing, metres = 3.0 + (k % 100) / 100.0, 6.0 + (k % 70) / 100.0, (q * 7) % 360, q * 40
    to = geo.destination(lon, lat, bearing, metres)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(stats.compactness(p, F.when(k % 9 != 0, q * 100).otherwise(0.0)), 9).alias("compactness"), stats.relative_direction(q, F.when(k % 8 != 0, (k % 50).cast("double"))).alias("direction"),
        lon.alias("lon"), lat.alias("lat"), to.alias("to"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "compactness", "direction", F.round("to.lon", 7).alias("to_lon"), F.round("to.lat", 7).alias("to_lat"), F.round(geo.haversine(F.col("lon"), F.col("lat"), F.col("to.lon"), F.col("to.lat")), 3).alias("metres"))


MEASURES = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS k, l_quantity AS q, l_extendedprice AS p, 3::DOUBLE + (l_suppkey % 100)::DOUBLE / 100 AS lon, radians(6::DOUBLE + (l_suppkey % 70)::DOUBLE / 100) AS lat, radians((l_quantity * 7) % 360) AS b, l_quantity * 40 / 6371008.8::DOUBLE AS d FROM lineitem),
t AS (SELECT *, asin(sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b)) AS y FROM l),
u AS (SELECT *, degrees(atan2(sin(b) * sin(d) * cos(lat), cos(d) - sin(lat) * sin(y))) AS turn FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k % 9 <> 0 THEN round(least(1::DOUBLE, {4 * math.pi}::DOUBLE * p / (q * 100 * q * 100)), 9) END AS compactness,
  CASE WHEN k % 8 = 0 THEN NULL WHEN greatest(q, k % 50) = 0 OR abs(q - k % 50) / greatest(q, k % 50) <= 0.05::DOUBLE THEN 'similar' WHEN q > k % 50 THEN 'higher' ELSE 'lower' END AS direction, round(lon + turn, 7) AS to_lon, round(degrees(y), 7) AS to_lat, round(q * 40, 3) AS metres FROM u
"""

ENTRIES = {
    "parsed_cells": (parsed_cells, PARSED_CELLS),
    "resolved_sites": (resolved_sites, RESOLVED_SITES),
    "resolved_airports": (resolved_airports, RESOLVED_AIRPORTS),
    "rating_matrix": (rating_matrix, RATING_MATRIX),
    "population_radius": (population_radius, POPULATION_RADIUS),
    "measures": (measures, MEASURES),
}
