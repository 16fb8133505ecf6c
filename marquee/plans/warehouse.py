"""Relational warehouse queries over the order tables, each with its SQL.

The star schema stands in for placements: a line item is a placement, its order's
quarter the period, region and nation the state and city, part type and brand the
category and format, the extended price the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import ids, stats, text
from marquee.operators import heads, relational


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their dimension lookups.  The dimensions carry no hint: Spark broadcasts those it knows to be small."""
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("line_rate"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.month("o_orderdate").alias("month"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("state"), F.col("n_name").alias("city"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("format"), "p_retailprice")
    joined = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))


PLACEMENTS_SQL = """
placements AS (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, r_name AS state, n_name AS city, p_type AS category, p_brand AS format,
  c_mktsegment, p_retailprice, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS line_rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)
"""


def rate_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    return relational.rate_benchmarks(placements(spark, sf), {"line": "line_rate", "retail": "p_retailprice"})


RATE_BENCHMARKS = f"""
WITH {PLACEMENTS_SQL},
bases AS (SELECT *, 'line' AS rate_basis, line_rate AS rate FROM placements UNION ALL SELECT *, 'retail', p_retailprice FROM placements),
g AS (SELECT rate_basis, year, quarter, category, format, state, city, grouping(state) * 2 + grouping(city) AS gl,
  count(*) AS n_rows, count(rate) AS n_rated, min(rate) AS lo, quantile_cont(rate, 0.25) AS p25, quantile_cont(rate, 0.5) AS p50, quantile_cont(rate, 0.75) AS p75, max(rate) AS hi, sum(rate::DECIMAL(28, 4))::DOUBLE / nullif(count(rate), 0) AS mean
  FROM bases GROUP BY GROUPING SETS ((rate_basis, year, quarter, category, format), (rate_basis, year, quarter, category, format, state), (rate_basis, year, quarter, category, format, state, city)))
SELECT 'rate:' || md5(concat_ws('|', lvl, rate_basis, year, quarter, category, format, coalesce(state, '-'), coalesce(city, '-'))) AS rate_id, lvl AS level, rate_basis,
  year::BIGINT AS year, quarter::BIGINT AS quarter, category, format, state, city, n_rows::BIGINT AS n_rows, n_rated::BIGINT AS n_rated, (n_rows - n_rated)::BIGINT AS n_missing,
  round(lo, 4) AS min_rate, round(p25, 4) AS p25_rate, round(p50, 4) AS p50_rate, round(p75, 4) AS p75_rate, round(hi, 4) AS max_rate, floor(mean * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS avg_rate
FROM (SELECT *, CASE gl WHEN 3 THEN 'national' WHEN 1 THEN 'state' ELSE 'city' END AS lvl FROM g)
"""


def entity_activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = placements(spark, sf).select("year", "quarter", F.when(F.col("month") % 3 != 0, F.col("month")).alias("month"), "state", "city", "category", "format", F.col("c_mktsegment").alias("advertiser"))
    return relational.entity_activity(rows, ["advertiser", "category", "format"]).withColumn("month", F.col("month").cast("string"))


ENTITY_ACTIVITY = f"""
WITH {PLACEMENTS_SQL},
u AS (SELECT year, quarter, CASE WHEN month % 3 <> 0 THEN month END AS month, state, city, t.entity_type, t.entity
  FROM placements, LATERAL (VALUES ('advertiser', c_mktsegment), ('category', category), ('format', format)) AS t(entity_type, entity)),
g AS (SELECT 'quarter' AS period, year, quarter, NULL::INT AS month, entity_type, entity, state, city, grouping(state) * 2 + grouping(city) AS gl, count(*) AS n FROM u
    GROUP BY GROUPING SETS ((year, quarter, entity_type, entity), (year, quarter, entity_type, entity, state), (year, quarter, entity_type, entity, state, city))
  UNION ALL SELECT 'month', year, quarter, month, entity_type, entity, state, city, grouping(state) * 2 + grouping(city), count(*) FROM u WHERE month IS NOT NULL
    GROUP BY GROUPING SETS ((year, quarter, month, entity_type, entity), (year, quarter, month, entity_type, entity, state), (year, quarter, month, entity_type, entity, state, city)))
SELECT period, year::BIGINT AS year, quarter::BIGINT AS quarter, month::VARCHAR AS month, entity_type, entity, CASE gl WHEN 3 THEN 'national' WHEN 1 THEN 'state' ELSE 'city' END AS level, state, city, n::BIGINT AS n_rows FROM g
"""


def period_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter"), F.when(F.col("o_orderstatus") == "O", "quarter_only").when(F.col("o_orderstatus") == "P", "combined").otherwise("month").alias("kind"))
    return rows.groupBy("year", "quarter", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


PERIOD_COVERAGE = """
SELECT year(o_orderdate)::BIGINT AS year, quarter(o_orderdate)::BIGINT AS quarter, CASE o_orderstatus WHEN 'O' THEN 'quarter_only' WHEN 'P' THEN 'combined' ELSE 'month' END AS kind, count(*)::BIGINT AS n_rows
FROM orders GROUP BY ALL
"""


def traffic_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve month columns per supplier, pivoted and taken apart again, with derived totals and flags."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.month("l_shipdate").alias("m"), "l_quantity", "l_returnflag")
    side = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    wide = rows.groupBy("l_suppkey").pivot("m", list(range(1, 13))).agg(side("A").alias("arrivals"), side("N").alias("departures"), F.sum("l_quantity").alias("total"))
    months = [(m, f"{m}_arrivals", f"{m}_departures", f"{m}_total") for m in range(1, 13)]
    return relational.unpivot_traffic(wide, ["l_suppkey"], months)


TRAFFIC_UNPIVOT = """
WITH w AS (SELECT l_suppkey, month(l_shipdate) AS month, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS arrivals, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS departures, sum(l_quantity) AS total FROM lineitem GROUP BY ALL),
f AS (SELECT s.l_suppkey, m.month, arrivals, departures, total FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN w ON w.l_suppkey = s.l_suppkey AND w.month = m.month)
SELECT l_suppkey, month::BIGINT AS month, arrivals, departures, total AS reported_total, arrivals + departures AS derived_total,
  concat_ws(',', CASE WHEN arrivals IS NULL THEN 'arrival_missing' END, CASE WHEN departures IS NULL THEN 'departure_missing' END, CASE WHEN total IS NULL THEN 'total_missing' END, CASE WHEN coalesce(abs(arrivals + departures - total) > 0.5, false) THEN 'total_mismatch' END) AS flags
FROM f
"""


def directional_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    value = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority").agg(
        F.round(F.sum(value), 2).alias("directional_total"), F.count_if(value.isNull()).alias("n_missing"), F.count_if(F.array_contains(F.array(F.lit("P"), F.lit("F")), F.col("o_orderstatus"))).alias("n_resolved")
    )


DIRECTIONAL_SUMS = """
SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority, round(sum(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END), 2) AS directional_total,
  count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS n_missing, count(*) FILTER (WHERE list_contains(['P', 'F'], o_orderstatus))::BIGINT AS n_resolved FROM orders GROUP BY ALL
"""


def vocabulary_aliases(spark: SparkSession, sf: str) -> DataFrame:
    columns = [("part", "p_name", "p_size"), ("part", "p_type", "p_size"), ("part", "p_brand", "p_size"), ("customer", "c_mktsegment", "c_nationkey"), ("supplier", "s_name", "s_nationkey")]
    found = None
    for t, c, y in columns:
        part = table(spark, sf, t).select(F.lit(c).alias("entity_type"), F.col(c).alias("literal"), F.col(y).cast("long").alias("year"))
        found = part if found is None else found.unionByName(part)
    return relational.vocabulary(found)


VOCABULARY_ALIASES = """
WITH u AS (SELECT 'p_name' AS entity_type, p_name AS literal, p_size AS year FROM part UNION ALL SELECT 'p_type', p_type, p_size FROM part UNION ALL SELECT 'p_brand', p_brand, p_size FROM part
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, c_nationkey FROM customer UNION ALL SELECT 's_name', s_name, s_nationkey FROM supplier),
g AS (SELECT entity_type, literal, count(*) AS n, min(year) AS a, max(year) AS b FROM u GROUP BY ALL),
k AS (SELECT *, nullif(trim(regexp_replace(lower(literal), '[^a-z0-9]+', ' ', 'g')), '') AS entity_key FROM g)
SELECT entity_type, literal, entity_key, n::BIGINT AS n_rows, a::BIGINT AS first_year, b::BIGINT AS last_year,
  'entity:' || substr(sha256('["' || entity_type || '","' || entity_key || '"]'), 1, 32) AS entity_id FROM k
"""


def representative_literal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("literal"))
    return relational.representative_literal(rows.withColumn("entity_key", text.entity_literal(F.col("literal"))))


REPRESENTATIVE_LITERAL = """
WITH l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS literal FROM part),
g AS (SELECT lower(literal) AS entity_key, literal, count(*) AS n FROM l GROUP BY ALL)
SELECT entity_key, first(literal ORDER BY n DESC, literal) AS literal, sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_literals FROM g GROUP BY entity_key
"""


def unique_state_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as airports of their nation; every third is alone in a state of its own."""
    state = F.when(F.col("s_suppkey") % 3 == 0, 1000 + F.col("s_suppkey")).otherwise(F.col("s_nationkey")).cast("long")
    rows = table(spark, sf, "supplier").select(state.alias("state"), F.col("s_name").alias("airport"))
    return relational.unique_anchor(rows, "state", "airport")


UNIQUE_STATE_ANCHOR = """
SELECT (CASE WHEN s_suppkey % 3 = 0 THEN 1000 + s_suppkey ELSE s_nationkey END)::BIGINT AS state, CASE WHEN count(DISTINCT s_name) = 1 THEN min(s_name) END AS airport, CASE WHEN count(DISTINCT s_name) = 1 THEN 'anchored' ELSE 'review' END AS status
FROM supplier GROUP BY 1
"""


def latest_order_head(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    head = heads.first_per(orders, ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")])
    customers = table(spark, sf, "customer").select("c_custkey")
    joined = customers.join(head, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("order_date"), F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"))


LATEST_ORDER_HEAD = """
SELECT c_custkey, o_orderkey, o_orderdate::DATE::VARCHAR AS order_date, coalesce(o_orderstatus, 'unknown') AS status FROM customer
LEFT JOIN (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC) ON o_custkey = c_custkey
"""


def coherent_snapshot_head(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("radius"), "l_quantity")
    head = heads.first_per(snapshots, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return head.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "radius", "l_quantity")


COHERENT_SNAPSHOT_HEAD = """
SELECT o_custkey, o_orderkey, l_linenumber::BIGINT AS radius, l_quantity FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) JOIN lineitem ON l_orderkey = o_orderkey
"""


def rows_as_array(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    packed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    shown = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ";")
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(packed.select("l_orderkey", shown.alias("lines"), F.size("a").cast("long").alias("n_lines")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit("")).alias("lines"), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


ROWS_AS_ARRAY = """
SELECT o_orderkey, coalesce(lines, '') AS lines, coalesce(n, 0)::BIGINT AS n_lines FROM orders LEFT JOIN
(SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def enrichment_queue(spark: SparkSession, sf: str) -> DataFrame:
    confirmed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    waiting = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(confirmed, "c_custkey", "left_anti")
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return waiting.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"), "c_mktsegment")


ENRICHMENT_QUEUE = """
SELECT c_custkey, n_name AS city, r_name AS state, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
"""


def ready_semi(spark: SparkSession, sf: str) -> DataFrame:
    busy = table(spark, sf, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'A'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(busy, "s_suppkey", "left_semi")


READY_SEMI = "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49 AND l_returnflag = 'A')"


def name_link_union(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select("s_suppkey", F.regexp_extract("s_name", r"(\d+)$", 1).alias("number"), F.col("s_nationkey").cast("long").alias("place"))
    customers = table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).alias("number"), F.col("c_nationkey").cast("long").alias("c_place"))
    by_name = names.join(customers, "number").select("s_suppkey", "c_custkey")
    by_alias = names.join(customers, (names["s_suppkey"] == F.col("c_custkey")) & (F.col("place") == F.col("c_place"))).select("s_suppkey", "c_custkey")
    return by_name.union(by_alias).distinct()


NAME_LINK_UNION = """
SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON regexp_extract(s_name, '(\\d+)$', 1) = regexp_extract(c_name, '(\\d+)$', 1)
UNION SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey
"""


def lineage_self_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    child = orders.select(F.col("o_orderkey").alias("child_key"), F.col("o_custkey").alias("owner"), F.floor(F.col("o_orderkey") / 2).alias("parent_key"))
    parent = orders.select(F.col("o_orderkey").alias("parent_key"), F.col("o_orderstatus").alias("parent_status"))
    return child.join(parent, "parent_key").select("child_key", "parent_key", "owner", "parent_status")


LINEAGE_SELF_JOIN = "SELECT c.o_orderkey AS child_key, p.o_orderkey AS parent_key, c.o_custkey AS owner, p.o_orderstatus AS parent_status FROM orders c JOIN orders p ON p.o_orderkey = c.o_orderkey // 2"


def smallest_container(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as points (their size) and intervals of sizes as extents; the smallest extent that holds the point, and how many do."""
    points = table(spark, sf, "part").select("p_partkey", "p_size")
    extents = table(spark, sf, "nation").select(F.col("n_nationkey").alias("extent"), F.col("n_nationkey").alias("low"), (2 * F.col("n_nationkey") + 5).alias("high"))
    covered = extents.withColumn("p_size", F.explode(F.sequence("low", "high")))
    pairs = points.join(covered, "p_size")
    whole = Window.partitionBy("p_partkey")
    ranked = pairs.select("p_partkey", F.col("extent").cast("long").alias("extent"), F.row_number().over(whole.orderBy(F.col("high") - F.col("low"), "extent")).alias("rn"), F.count(F.lit(1)).over(whole).alias("n_extents"))
    return ranked.where("rn = 1").drop("rn")


SMALLEST_CONTAINER = """
SELECT p_partkey, n_nationkey::BIGINT AS extent, n::BIGINT AS n_extents FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey + 5, n_nationkey) AS rn, count(*) OVER (PARTITION BY p_partkey) AS n
FROM part JOIN nation ON p_size BETWEEN n_nationkey AND 2 * n_nationkey + 5) WHERE rn = 1
"""


def midrank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return parts.select("p_partkey", F.round(stats.midrank(F.col("p_retailprice"), F.col("p_brand")), 6).alias("midrank"))


MIDRANK_PERCENTILE = """
SELECT p_partkey, round(100.0::DOUBLE * ((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1) + 0.5::DOUBLE * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 6) AS midrank FROM part
"""


def site_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("long").alias("zone"), F.round(F.col("s_acctbal") + 2000, 2).alias("rate"), ((F.col("s_suppkey") * 37) % 100).cast("double").alias("score")
    )


SITE_SCORES = "sites AS (SELECT s_suppkey, s_nationkey::BIGINT AS zone, round(s_acctbal + 2000, 2) AS rate, ((s_suppkey * 37) % 100)::DOUBLE AS score FROM supplier)"
TOP2 = f"{SITE_SCORES}, top2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY score DESC, rate, s_suppkey) AS rn FROM sites) WHERE rn <= 2)"


def top2_per_zone(spark: SparkSession, sf: str) -> DataFrame:
    return heads.top_per(site_scores(spark, sf), ["zone"], [F.desc("score"), F.col("rate"), F.col("s_suppkey")], 2).select("zone", "s_suppkey", "rate", "score", F.col("rank").cast("long").alias("rank"))


TOP2_PER_ZONE = f"WITH {TOP2} SELECT zone, s_suppkey, rate, score, rn::BIGINT AS rank FROM top2"


def zone_packages(spark: SparkSession, sf: str) -> DataFrame:
    return relational.zone_packages(site_scores(spark, sf), budget=20_000.0)


ZONES_SQL = f"""
{TOP2}, z AS (SELECT zone, avg(score) AS zs FROM top2 GROUP BY zone ORDER BY zs DESC, zone LIMIT 8),
v AS (SELECT zone, s_suppkey::VARCHAR AS ids, rate AS cost, score AS s, 1 AS n FROM top2 JOIN z USING (zone) WHERE rn = 1
  UNION ALL SELECT zone, string_agg(s_suppkey::VARCHAR, '|' ORDER BY rn), sum(rate), sum(score), 2 FROM top2 JOIN z USING (zone) GROUP BY zone HAVING count(*) = 2),
packages AS (SELECT a.ids || '|' || b.ids || '|' || c.ids AS package_id, round(a.cost + b.cost + c.cost, 2) AS cost, round((a.s + b.s + c.s) / (a.n + b.n + c.n), 6) AS fit, a.n + b.n + c.n AS n_sites
  FROM v a JOIN v b ON a.zone < b.zone JOIN v c ON b.zone < c.zone WHERE round(a.cost + b.cost + c.cost, 2) <= 20000)
"""
ZONE_PACKAGES = f"WITH {ZONES_SQL} SELECT package_id, cost, fit, n_sites::BIGINT AS n_sites, row_number() OVER (ORDER BY fit DESC, cost, package_id)::BIGINT AS rank FROM packages"


def package_options(spark: SparkSession, sf: str) -> DataFrame:
    return relational.package_options(zone_packages(spark, sf))


PACKAGE_OPTIONS = f"""
WITH {ZONES_SQL}, best AS (SELECT * FROM packages ORDER BY fit DESC, cost, package_id LIMIT 1),
largest AS (SELECT * FROM packages WHERE package_id NOT IN (SELECT package_id FROM best) ORDER BY n_sites DESC, fit DESC, cost, package_id LIMIT 1),
cheap AS (SELECT p.* FROM packages p, best WHERE p.package_id NOT IN (SELECT package_id FROM best UNION SELECT package_id FROM largest) ORDER BY p.fit >= best.fit - 5 DESC, CASE WHEN p.fit >= best.fit - 5 THEN p.cost END, p.fit DESC, p.cost, p.package_id LIMIT 1)
SELECT 'best_overall' AS style, package_id, cost, fit FROM best UNION ALL SELECT 'maximum_delivery', package_id, cost, fit FROM largest UNION ALL SELECT 'budget_smart', package_id, cost, fit FROM cheap
"""


def evidence_grades(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    part = lambda m: ((k * m) % 101).cast("double")
    score = stats.evidence_score(part(13), part(29), part(31), part(47), part(59), part(7), F.array(F.lit(95.0), part(83) + 20))
    zero = k % 17 == 0
    rows = table(spark, sf, "supplier").select("s_suppkey", F.round(F.when(zero, 0.0).otherwise(score), 6).alias("score"), zero.alias("zero"))
    return rows.select("s_suppkey", "score", stats.evidence_grade(F.col("score"), F.col("zero")).alias("grade"))


EVIDENCE_GRADES = """
WITH s AS (SELECT s_suppkey, s_suppkey % 17 = 0 AS zero, round(CASE WHEN s_suppkey % 17 = 0 THEN 0.0::DOUBLE ELSE least(
  0.25::DOUBLE * ((s_suppkey * 13) % 101) + 0.25::DOUBLE * ((s_suppkey * 29) % 101) + 0.2::DOUBLE * ((s_suppkey * 31) % 101) + 0.2::DOUBLE * ((s_suppkey * 47) % 101) + 0.1::DOUBLE * ((s_suppkey * 59) % 101),
  ((s_suppkey * 7) % 101) + 15.0::DOUBLE, 95.0::DOUBLE, ((s_suppkey * 83) % 101) + 20.0::DOUBLE) END, 6) AS score FROM supplier)
SELECT s_suppkey, score, CASE WHEN zero OR score < 40 THEN 'unavailable' WHEN score < 55 THEN 'D' WHEN score < 70 THEN 'C' WHEN score < 85 THEN 'B' ELSE 'A' END AS grade FROM s
"""


def price_summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    price = F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice"))
    found = relational.split_percentiles(rows.select("l_returnflag", "l_linestatus", price.alias("price")), ["l_returnflag", "l_linestatus"], "price")
    average = F.round(F.col("total") / F.nullif(F.col("n_rated"), F.lit(0)), 4)
    return found.select("l_returnflag", "l_linestatus", "n_rows", "n_rated", F.round("lo", 4).alias("min_price"), *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")], F.round("hi", 4).alias("max_price"), average.alias("avg_price"))


PRICE_SUMMARY_STATS = """
WITH p AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_discount < 0.09::DOUBLE THEN l_extendedprice END AS price FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n_rows, count(price)::BIGINT AS n_rated, round(min(price), 4) AS min_price, round(quantile_cont(price, 0.25), 4) AS p25, round(median(price), 4) AS p50,
  round(quantile_cont(price, 0.75), 4) AS p75, round(max(price), 4) AS max_price, round(avg(price), 4) AS avg_price FROM p GROUP BY ALL
"""


def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation")
    return rows.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a")).select(
        "region", F.md5(F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["n_name"], x["n_nationkey"].cast("string"))), "|")).alias("fingerprint"), F.size("a").cast("long").alias("n_rows")
    )


FINGERPRINT = "SELECT n_regionkey::BIGINT AS region, md5(string_agg(n_name || '=' || n_nationkey, '|' ORDER BY n_nationkey)) AS fingerprint, count(*)::BIGINT AS n_rows FROM nation GROUP BY 1"


def dup_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("order_date"))
    return heads.duplicates(rows, ["o_custkey", "order_date"])


DUP_GUARD = "SELECT o_custkey, o_orderdate::DATE::VARCHAR AS order_date, count(*)::BIGINT AS n_rows FROM orders GROUP BY ALL HAVING count(*) > 1"


def tie_order(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    w = Window.partitionBy("p_brand").orderBy(F.desc_nulls_last("p_size"), "p_name", "p_partkey")
    return parts.select("p_partkey", F.row_number().over(w).cast("long").alias("position"))


TIE_ORDER = "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_name, p_partkey)::BIGINT AS position FROM part"


def site_owner_status(spark: SparkSession, sf: str) -> DataFrame:
    """Latest owner assertion per site, or unknown."""
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    head = heads.first_per(lines, ["l_partkey"], [F.desc("l_shipdate"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")])
    owner = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    named = head.join(owner, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_partkey", "s_name")
    return table(spark, sf, "part").select("p_partkey").join(named, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("s_name", F.lit("unknown")).alias("owner"))


SITE_OWNER_STATUS = """
SELECT p_partkey, coalesce(s_name, 'unknown') AS owner FROM part LEFT JOIN (SELECT DISTINCT ON (l_partkey) l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_partkey, l_shipdate DESC, l_suppkey, l_orderkey, l_linenumber) ON l_partkey = p_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey
"""

ENTRIES = {
    "rate_benchmarks": (rate_benchmarks, RATE_BENCHMARKS),
    "entity_activity": (entity_activity, ENTITY_ACTIVITY),
    "period_coverage": (period_coverage, PERIOD_COVERAGE),
    "traffic_unpivot": (traffic_unpivot, TRAFFIC_UNPIVOT),
    "directional_sums": (directional_sums, DIRECTIONAL_SUMS),
    "vocabulary_aliases": (vocabulary_aliases, VOCABULARY_ALIASES),
    "representative_literal": (representative_literal, REPRESENTATIVE_LITERAL),
    "unique_state_anchor": (unique_state_anchor, UNIQUE_STATE_ANCHOR),
    "latest_order_head": (latest_order_head, LATEST_ORDER_HEAD),
    "coherent_snapshot_head": (coherent_snapshot_head, COHERENT_SNAPSHOT_HEAD),
    "rows_as_array": (rows_as_array, ROWS_AS_ARRAY),
    "enrichment_queue": (enrichment_queue, ENRICHMENT_QUEUE),
    "ready_semi": (ready_semi, READY_SEMI),
    "name_link_union": (name_link_union, NAME_LINK_UNION),
    "lineage_self_join": (lineage_self_join, LINEAGE_SELF_JOIN),
    "smallest_container": (smallest_container, SMALLEST_CONTAINER),
    "midrank_percentile": (midrank_percentile, MIDRANK_PERCENTILE),
    "top2_per_zone": (top2_per_zone, TOP2_PER_ZONE),
    "zone_packages": (zone_packages, ZONE_PACKAGES),
    "package_options": (package_options, PACKAGE_OPTIONS),
    "evidence_grades": (evidence_grades, EVIDENCE_GRADES),
    "price_summary_stats": (price_summary_stats, PRICE_SUMMARY_STATS),
    "fingerprint": (fingerprint, FINGERPRINT),
    "dup_guard": (dup_guard, DUP_GUARD),
    "tie_order": (tie_order, TIE_ORDER),
    "site_owner_status": (site_owner_status, SITE_OWNER_STATUS),
}
