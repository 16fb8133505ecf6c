"""Constraints, assertions, requests, plan changes and sheet rows over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import adjust, assertions, checks, parse, policies, runs, site_context
from marquee.operators.heads import top_per
from marquee.plans.rules import SECTORS, listed, pick
from marquee.plans.warehouse import table


def constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules each line item breaks, read as a population and as a settlement row."""
    k, n, q = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")
    population = {
        "candidates": k % 100 + n, "valid": k % 100, "nodata": F.when(k % 13 == 0, n + 1).otherwise(n), "reachable": F.when(k % 17 == 0, k % 100 + 1).otherwise(k % 90), "unavailable": F.when(k % 19 == 0, k % 100 + 2).otherwise(k % 80),
        "max_minutes": q + F.when(k % 23 == 0, 0.5).otherwise(0.0), "threshold": q,
    }
    empty = k % 7 == 0
    settlement = {
        "settled": F.when(empty, 0.0).otherwise(q * 10), "buffer": F.when(k % 29 == 0, q * 9).otherwise(q * 20), "largest": F.when(empty, F.when(k % 3 == 0, 1.0).otherwise(0.0)).otherwise(q * F.when(k % 31 == 0, 11).otherwise(5)), "extents": F.when(empty, 0).otherwise(1),
        "components": F.when(empty, 0).otherwise(F.when(k % 11 == 0, 0).otherwise(2)), "largest_share": F.when(~empty, 0.5), "inside": k % 2 == 0, "nearest": F.when(k % 2 == 0, F.when(k % 37 == 0, 3.0).otherwise(0.0)).otherwise(F.when(k % 5 != 0, 12.0)),
    }
    rules = checks.population_rules(population) | checks.settlement_rules(settlement)
    coverage = checks.coverage_status(k % 3 == 0, k % 4 == 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(checks.broken(rules), "|").alias("broken"), coverage.alias("coverage"))


CONSTRAINT_CHECKS = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_linenumber AS n, l_quantity AS q, l_partkey % 7 = 0 AS e FROM lineitem),
x AS (SELECT *, k % 100 AS valid, CASE WHEN e THEN 0 ELSE q * 10 END AS settled, CASE WHEN k % 29 = 0 THEN q * 9 ELSE q * 20 END AS buf, CASE WHEN e THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END ELSE q * CASE WHEN k % 31 = 0 THEN 11 ELSE 5 END END AS largest, CASE WHEN e THEN 0 WHEN k % 11 = 0 THEN 0 ELSE 2 END AS comps,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 37 = 0 THEN 3 ELSE 0 END WHEN k % 5 <> 0 THEN 12 END AS nearest FROM r)
SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN k % 13 = 0 THEN 'cell_accounting' END, CASE WHEN k % 17 = 0 THEN 'reachable' WHEN k % 90 > valid THEN 'reachable' END, CASE WHEN k % 19 = 0 THEN 'friction_unavailable' WHEN k % 80 > valid THEN 'friction_unavailable' END,
  CASE WHEN k % 23 = 0 THEN 'threshold_frontier' END, CASE WHEN settled > buf * 1.00000001::DOUBLE THEN 'settled_within_buffer' END, CASE WHEN largest > settled * 1.00000001::DOUBLE THEN 'largest_within_settled' END,
  CASE WHEN NOT ((settled = 0 AND e AND comps = 0 AND largest = 0) OR (settled > 0 AND NOT e AND comps > 0 AND largest > 0)) THEN 'component_alignment' END,
  CASE WHEN NOT (CASE WHEN k % 2 = 0 THEN nearest = 0 ELSE nearest IS NOT NULL AND nearest >= 0 END) THEN 'nearest_alignment' END) AS broken,
  CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'full' WHEN k % 3 = 0 THEN 'places_only' WHEN k % 4 = 0 THEN 'roads_only' ELSE 'uncovered' END AS coverage FROM x
"""


def coordinate_assertions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds, rights = ("customer_capture", "field_survey", "open_dataset", "licensed_provider"), ("customer_captured", "open_licensed", "provider_derived", "unknown")
    kind, right = pick(kinds, k), F.when(k % 3 == 0, pick(rights, F.floor(k / 3).cast("long"))).otherwise(pick(("customer_captured", "customer_captured", "open_licensed", "provider_derived"), k))
    status = pick(("approved", "pending", "approved", "revoked", "approved"), F.floor(k / 2).cast("long"))
    lat, lon = (k % 1850) / 10.0 - 92, (k % 3601) / 10.0 - 180
    c = {"lat": lat, "lon": lon, "accuracy": F.when(k % 11 != 0, (k % 50) - 1), "source_kind": kind, "rights": right, "status": status, "artifact": F.when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")), "license": F.when(k % 7 != 0, "cc-by")}
    identity = assertions.coordinate_id(F.col("o_custkey").cast("string"), lat, lon, F.lit("src"), c["artifact"], F.lit("r1"))
    rows = table(spark, sf, "orders").select("o_orderkey", assertions.coordinate_failure(c).alias("failure"), assertions.renderer(status, right).alias("renderer"), identity.alias("assertion_id"))
    return rows.withColumn("renderer", F.when(F.col("failure").isNull(), F.col("renderer")))


COORDINATE_ASSERTIONS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey, ['customer_capture', 'field_survey', 'open_dataset', 'licensed_provider'][o_orderkey % 4 + 1] AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN ['customer_captured', 'open_licensed', 'provider_derived', 'unknown'][(o_orderkey // 3) % 4 + 1] ELSE ['customer_captured', 'customer_captured', 'open_licensed', 'provider_derived'][o_orderkey % 4 + 1] END AS rights,
  ['approved', 'pending', 'approved', 'revoked', 'approved'][(o_orderkey // 2) % 5 + 1] AS status, (o_orderkey % 1850)::DOUBLE / 10::DOUBLE - 92 AS lat, (o_orderkey % 3601)::DOUBLE / 10::DOUBLE - 180 AS lon, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 - 1 END AS acc,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS art, o_orderkey % 7 <> 0 AS lic FROM orders),
f AS (SELECT *, CASE WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'COORDINATE_OUT_OF_RANGE' WHEN acc < 0 THEN 'ACCURACY_INVALID' WHEN rights = 'customer_captured' AND kind NOT IN ('customer_capture', 'field_survey') THEN 'CUSTOMER_CAPTURED_RIGHTS_REQUIRE_CAPTURE_OR_FIELD_SURVEY'
  WHEN rights = 'open_licensed' AND kind <> 'open_dataset' THEN 'OPEN_LICENSED_RIGHTS_REQUIRE_OPEN_DATASET' WHEN rights = 'provider_derived' AND kind <> 'licensed_provider' THEN 'PROVIDER_DERIVED_RIGHTS_REQUIRE_LICENSED_PROVIDER' WHEN rights = 'unknown' AND status = 'approved' THEN 'UNKNOWN_SPATIAL_RIGHTS_CANNOT_BE_APPROVED'
  WHEN status = 'approved' AND acc IS NULL THEN 'APPROVED_COORDINATE_ACCURACY_REQUIRED' WHEN status = 'approved' AND art = '' THEN 'APPROVED_COORDINATE_SOURCE_ARTIFACT_REQUIRED' WHEN status = 'approved' AND rights IN ('customer_captured', 'open_licensed') AND NOT lic THEN 'APPROVED_MAPLIBRE_SPATIAL_LICENSE_REQUIRED' END AS failure FROM o)
SELECT k AS o_orderkey, failure, CASE WHEN failure IS NULL THEN CASE WHEN status = 'approved' AND rights IN ('customer_captured', 'open_licensed') THEN 'maplibre' WHEN status = 'approved' AND rights = 'provider_derived' THEN 'provider_only' ELSE 'none' END END AS renderer,
  'coordinate:' || substr(sha256('["' || o_custkey || '","' || printf('%.8f', lat) || '","' || printf('%.8f', lon) || '","src","' || art || '","r1"]'), 1, 32) AS assertion_id FROM f
"""


def manual_alias_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Airport assertions per line item by ship mode, with manual aliases first, joined back to the facts of one resolver version."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_returnflag", "l_linestatus")
    record = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    literal = F.concat("l_returnflag", F.lit(" "), F.col("l_suppkey") % 20)
    auto = lines.select(record.alias("record_id"), literal.alias("literal"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("airport-"), F.col("l_suppkey") % 5)).alias("airport_id"), F.lit("exact_name").alias("method"))
    manual = table(spark, sf, "supplier").where("s_suppkey % 4 = 1").select(F.format_string("alias-%08d", "s_suppkey").alias("alias_id"), F.concat(F.lit(" R "), F.col("s_suppkey") % 20, F.lit(" ")).alias("literal"), F.concat(F.lit("manual-"), F.col("s_suppkey") % 7).alias("airport_id"))
    resolved = assertions.manual_first(auto, manual)
    file = F.concat(F.lit("sha"), F.col("l_suppkey") % 2)
    facts = lines.select(F.lit("monthly").alias("scope"), F.lit("src").alias("source_id"), file.alias("sha256"), record.alias("record_id"), F.col("l_linestatus").alias("status"))
    asserted = resolved.select(F.lit("monthly").alias("scope"), F.lit("src").alias("source_id"), F.lit("sha1").alias("sha256"), "record_id", "airport_id", "method", F.lit("v2").alias("resolver_version"))
    joined = assertions.with_assertions(facts, asserted, "v2")
    return joined.groupBy("status", F.coalesce("airport_id", F.lit("none")).alias("airport_id")).agg(F.count(F.lit(1)).alias("n_rows"))


MANUAL_ALIAS_PRECEDENCE = """
WITH m AS (SELECT literal, min_by(airport, alias) AS airport FROM (SELECT 'R ' || (s_suppkey % 20) AS literal, 'manual-' || (s_suppkey % 7) AS airport, printf('alias-%08d', s_suppkey) AS alias FROM supplier WHERE s_suppkey % 4 = 1) GROUP BY 1),
l AS (SELECT l_linestatus AS status, l_suppkey % 2 AS f, coalesce(m.airport, CASE WHEN l_suppkey % 3 <> 0 THEN 'airport-' || (l_suppkey % 5) END) AS airport FROM lineitem LEFT JOIN m ON m.literal = l_returnflag || ' ' || (l_suppkey % 20))
SELECT status, coalesce(CASE WHEN f = 1 THEN airport END, 'none') AS airport_id, count(*)::BIGINT AS n_rows FROM l GROUP BY ALL
"""


def alias_collisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.lit("label").alias("kind"), F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey") % 40).alias("literal"), F.concat(F.lit("airport-"), F.col("c_nationkey") % 3).alias("airport_id"))
    return assertions.alias_counts(rows)


ALIAS_COLLISIONS = """
SELECT 'label' AS kind, c_mktsegment || '-' || (c_custkey % 40) AS literal, count(*)::BIGINT AS n_rows, CASE WHEN count(DISTINCT c_nationkey % 3) = 1 THEN 'airport-' || min(c_nationkey % 3) END AS airport_id, count(DISTINCT c_nationkey % 3) > 1 AS collision FROM customer GROUP BY ALL
"""


def updated_from(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return assertions.update_from(target, changes, ["c_custkey"], ["c_mktsegment"])


UPDATED_FROM = """
SELECT c_custkey, c_nationkey, CASE WHEN o.k IS NULL THEN c_mktsegment ELSE o.p END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS p FROM orders GROUP BY 1) o ON o.k = c_custkey
"""


def activity_potential(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' balances among those of the suppliers."""
    values = table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 100).alias("value"))
    cohort = table(spark, sf, "supplier").select(F.round(F.col("s_acctbal") / 100).alias("value"))
    return checks.activity_potential(values, cohort, ["c_custkey"]).select("c_custkey", F.round("potential", 6).alias("potential"))


ACTIVITY_POTENTIAL = """
WITH c AS (SELECT round(s_acctbal / 100) AS v, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), x AS (SELECT c_custkey, round(c_acctbal / 100) AS v FROM customer),
d AS (SELECT v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.v < u.v) AS below, (SELECT coalesce(sum(n), 0) FROM c WHERE c.v = u.v) AS same FROM (SELECT DISTINCT v FROM x) u)
SELECT c_custkey, CASE WHEN total >= 30 THEN round(100.0::DOUBLE * (below + 0.5::DOUBLE * same) / total, 6) END AS potential FROM x JOIN d USING (v), t
"""


def claim_and_request_checks(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    kind = pick(("scenario_target_reach", "calibrated_target_reach", "influence_capture", "influence_weighted_coverage"), k)
    share = kind.isin("influence_capture", "influence_weighted_coverage")
    high = F.when(share, (k % 120).cast("double")).otherwise(p)
    claim = checks.claim_failure(kind, high * 0.5, F.when(k % 9 == 0, high * 1.5).otherwise(high * 0.8), high, p * F.when(k % 5 == 0, 0.5).otherwise(2.0), F.when(k % 6 == 0, "assumed").otherwise("modelled"), F.when(k % 7 == 0, "C").otherwise("D"), k % 8 < 4)
    day = F.to_date("o_orderdate")
    end, deadline = F.date_add(day, (k % 30 - 2).cast("int")), F.date_add(day, (k % 10 - 8).cast("int"))
    request = checks.request_failure(k % 11 != 0, day, end, deadline, F.when(k % 13 == 0, " x ").otherwise("Buyer"), F.when(k % 17 == 0, "a@b").otherwise("a@b.example"))
    return table(spark, sf, "orders").select("o_orderkey", claim.alias("claim_failure"), request.alias("request_failure"))


CLAIM_AND_REQUEST_CHECKS = """
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate::DATE AS d, o_orderkey % 4 AS kind, CASE WHEN o_orderkey % 4 >= 2 THEN (o_orderkey % 120)::DOUBLE ELSE o_totalprice END AS h FROM orders)
SELECT k AS o_orderkey, CASE WHEN NOT (h * 0.5::DOUBLE <= CASE WHEN k % 9 = 0 THEN h * 1.5::DOUBLE ELSE h * 0.8::DOUBLE END AND CASE WHEN k % 9 = 0 THEN h * 1.5::DOUBLE ELSE h * 0.8::DOUBLE END <= h) THEN 'RANGE_ORDER_INVALID' WHEN kind < 2 AND h > p * CASE WHEN k % 5 = 0 THEN 0.5::DOUBLE ELSE 2::DOUBLE END THEN 'REACH_EXCEEDS_UNIVERSE'
  WHEN kind >= 2 AND h > 100 THEN 'PERCENTAGE_EXCEEDS_100' WHEN kind >= 2 AND k % 8 >= 4 AND (k % 6 <> 0 OR k % 7 = 0) THEN 'SCENARIO_INFLUENCE_NOT_ASSUMED_D' WHEN kind >= 2 AND k % 8 < 4 AND k % 6 = 0 THEN 'QUANTILE_INFLUENCE_NOT_MODELLED' END AS claim_failure,
  CASE WHEN k % 13 = 0 THEN 'BUYER_NAME_REQUIRED' WHEN k % 17 = 0 THEN 'BUYER_EMAIL_INVALID' WHEN k % 11 = 0 THEN 'FLIGHT_DATES_NOT_CONFIRMED' WHEN d > d + (k % 30 - 2)::INT THEN 'FLIGHT_DATE_ORDER_INVALID' WHEN d + (k % 10 - 8)::INT >= d THEN 'RESPONSE_DEADLINE_TOO_LATE' END AS request_failure FROM o
"""


def adjustment_options(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as faces with their nations as zones; a plan per region with the region's three lowest keys."""
    sites = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_nationkey").cast("string").alias("zone_id"), F.col("s_acctbal").alias("rate"), (F.col("s_suppkey") % 5 != 0).alias("flies"))
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("zone_id"), F.col("n_regionkey").alias("plan_id"))
    three = top_per(sites.join(regions, "zone_id"), ["plan_id"], [F.col("site_id").cast("long")], 3)
    plans = three.groupBy("plan_id").agg(F.array_sort(F.collect_list("site_id")).alias("sites"))
    found = adjust.adjustment_options(sites, plans, F.col("flies"))
    return found.select("plan_id", "action", "subject", "option", F.col("place").cast("long").alias("place"))


ADJUSTMENT_OPTIONS = """
WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS zone, s_acctbal AS rate, s_suppkey % 5 <> 0 AS flies, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT region AS plan_id, id, zone FROM s QUALIFY row_number() OVER (PARTITION BY region ORDER BY k) <= 3), z AS (SELECT DISTINCT plan_id, zone FROM c),
f AS (SELECT plan_id, id, zone, rate FROM s JOIN z USING (zone) WHERE flies AND NOT EXISTS (SELECT 1 FROM c WHERE c.plan_id = z.plan_id AND c.id = s.id))
SELECT plan_id, 'add' AS action, zone AS subject, id AS option, row_number() OVER (PARTITION BY plan_id ORDER BY zone || '|' || id)::BIGINT AS place FROM f
UNION ALL SELECT c.plan_id, 'replace', c.id, f.id, row_number() OVER (PARTITION BY c.plan_id, c.id ORDER BY rate, f.id) FROM c JOIN f ON f.plan_id = c.plan_id AND f.zone = c.zone
UNION ALL SELECT plan_id, 'zone', NULL, zone, row_number() OVER (PARTITION BY plan_id ORDER BY zone) FROM (SELECT p.plan_id, a.zone FROM (SELECT DISTINCT plan_id FROM c) p, (SELECT DISTINCT zone FROM s WHERE flies) a WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.plan_id = p.plan_id AND z.zone = a.zone))
"""


def plan_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Each order against itself as a changed plan."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")

    def plan(n: int):
        shift = F.lit(n)
        text = lambda c: c.cast("string")
        base = F.when((k + n) % 12 != 0, p + shift * (k % 5 - 2))
        return F.struct(
            pick(SECTORS, F.when(k % 7 == 0, k + n).otherwise(k)).alias("objective"), F.when(k % 6 != 0, F.concat(F.lit("key"), text(F.when(k % 9 == 0, shift).otherwise(0)))).alias("comparability_key"), (base * 0.9).alias("low"), base.alias("base"), (base * 1.1).alias("high"),
            (p * 2 + shift * (k % 3 - 1) * 10).alias("cost"), F.when((k + n) % 10 != 0, (k % 40 + n).cast("double")).alias("fit"), (k % 50 + n * 2).alias("evidence_score"), F.array(text(k % 4), text(k % 5 + 10 + shift * (k % 2)), F.lit("z")).alias("sites"), F.array(text(k % 3 + shift)).alias("zones"),
            *[F.when((k + n) % 15 != 0, (k % m + n * (k % 2)).cast("double")).alias(name) for name, m in zip(adjust.PILLARS, (2, 3, 5, 7, 11))],
        )

    pairs = table(spark, sf, "orders").select(k.alias("pair_id"), plan(0).alias("a"), plan(1).alias("b"))
    found = adjust.plan_deltas(pairs)
    return found.select("pair_id", "comparable", "reason", F.round("cost", 2).alias("cost"), "fit", "evidence_score", F.round("delivery", 2).alias("delivery"), *[F.array_join(c, "|").alias(c) for c in ("changed_sites", "changed_zones", "pillars")], "trade_off")


PLAN_DELTAS = f"""
WITH o AS (SELECT o_orderkey AS k, k % 7 = 0 AND {listed(SECTORS)}[k % 3 + 1] <> {listed(SECTORS)}[(k + 1) % 3 + 1] AS other, (k % 6 <> 0 AND k % 9 = 0) AS keyed, k % 12 <> 0 AND (k + 1) % 12 <> 0 AS whole FROM orders),
r AS (SELECT *, NOT other AND NOT keyed AS comparable, CASE WHEN other OR keyed THEN 'INCOMPARABLE_DELIVERY_BASIS' WHEN NOT whole THEN 'OBJECTIVE_DELIVERY_UNAVAILABLE' END AS reason, k % 5 - 2 AS gain, (k % 3 - 1) * 10 AS cost, (k % 15 <> 0) AS pa, ((k + 1) % 15 <> 0) AS pb FROM o)
SELECT k AS pair_id, comparable, reason, cost::DOUBLE AS cost, CASE WHEN k % 10 <> 0 AND (k + 1) % 10 <> 0 THEN 1::DOUBLE END AS fit, 2::BIGINT AS evidence_score, CASE WHEN reason IS NULL THEN gain::DOUBLE END AS delivery,
  CASE WHEN k % 2 = 1 THEN (k % 5 + 10) || '|' || (k % 5 + 11) ELSE '' END AS changed_sites, (k % 3) || '|' || (k % 3 + 1) AS changed_zones, CASE WHEN pa <> pb OR (pa AND k % 2 = 1) THEN 'A|D|C|P|E' ELSE '' END AS pillars,
  CASE WHEN reason IS NOT NULL THEN 'Audience delivery is shown side by side because the campaign settings changed.' ELSE 'Expected audience delivery ' || CASE WHEN gain > 0 THEN 'increases' WHEN gain < 0 THEN 'decreases' ELSE 'is unchanged' END || ' while cost ' || CASE WHEN cost > 0 THEN 'increases' WHEN cost < 0 THEN 'decreases' ELSE 'is unchanged' END || '.' END AS trade_off FROM r
"""


def weight_months(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet row per supplier, with months of two and of three columns."""
    k = F.col("s_suppkey")
    cells = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.when((k + i) % 11 == 0, "-").when((k + i) % 13 == 0, "n/a").otherwise(F.format_string("%d,%03d", (k + i) % 9, (k * i) % 1000)))
    rows = table(spark, sf, "supplier").select("s_suppkey", cells.alias("cells"))
    found = parse.weight_months(rows, ["s_suppkey"], "cells", [1, 3, 5, 7, 9, 11, 13, 16, 19, 22, 25, 28], 31)
    return found.select("s_suppkey", F.col("month").cast("long").alias("month"), "imports", "exports", "reported_total", "derived_total", F.array_join("flags", "|").alias("flags"))


WEIGHT_MONTHS = """
WITH m AS (SELECT * FROM (VALUES (1, 1, 3), (2, 3, 5), (3, 5, 7), (4, 7, 9), (5, 9, 11), (6, 11, 13), (7, 13, 16), (8, 16, 19), (9, 19, 22), (10, 22, 25), (11, 25, 28), (12, 28, 31)) t(month, a, b)),
c AS (SELECT s_suppkey, i, CASE WHEN (s_suppkey + i) % 11 = 0 OR (s_suppkey + i) % 13 = 0 THEN NULL ELSE ((s_suppkey + i) % 9 * 1000 + (s_suppkey * i) % 1000)::DOUBLE END AS v FROM supplier, (SELECT unnest(range(33)) AS i)),
x AS (SELECT p.s_suppkey, month, b - a >= 3 AS has, p.v AS imports, q.v AS exports, CASE WHEN b - a >= 3 THEN r.v END AS total FROM m JOIN c p ON p.i = a JOIN c q ON q.i = a + 1 AND q.s_suppkey = p.s_suppkey JOIN c r ON r.i = a + 2 AND r.s_suppkey = p.s_suppkey)
SELECT s_suppkey, month::BIGINT AS month, imports, exports, total AS reported_total, imports + exports AS derived_total,
  concat_ws('|', CASE WHEN imports IS NULL THEN 'import_missing' END, CASE WHEN exports IS NULL THEN 'export_missing' END, CASE WHEN has AND total IS NULL THEN 'reported_total_missing' END, CASE WHEN coalesce(abs(imports + exports - total) > 0.5::DOUBLE, false) THEN 'reported_total_mismatch' END) AS flags FROM x
"""


def board_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as board rows: which are kept, with flags, and which go to quarantine."""
    k = F.col("p_partkey")
    filled = lambda m, text: F.when(k % m != 0, text).otherwise("  ")
    cells = F.array(
        F.lit("1"), filled(17, F.col("p_brand")), F.lit("x"), F.lit("Lagos"), filled(23, F.lit(" Ikeja ")), F.col("p_name"), F.lit("b"), F.col("p_type"), F.lit("Unipole"), F.lit("good"), filled(31, F.lit("static")), F.when(k % 5 == 0, "-").otherwise("1,200,000"), F.lit("100,000.5"), F.lit(""),
        F.lit("Q1"), pick(("January", "march/April", "13th", ""), k),
    )
    blank = F.transform(cells, lambda c: F.lit(" "))
    rows = table(spark, sf, "part").select(F.lit("s").alias("source_id"), F.lit("NB").alias("sheet"), k.alias("source_row"), F.when(k % 29 == 0, blank).otherwise(cells).alias("cells"))
    good, bad = parse.board_quality_rows(rows, 2023)
    kept = good.select("source_row", F.lit("record").alias("outcome"), "city", "annual_rate", "monthly_rate", F.col("period.kind").alias("period"), F.array_join("flags", "|").alias("flags"))
    none = F.lit(None)
    return kept.unionByName(bad.select("source_row", F.col("reason").alias("outcome"), none.cast("string").alias("city"), none.cast("double").alias("annual_rate"), none.cast("double").alias("monthly_rate"), none.cast("string").alias("period"), none.cast("string").alias("flags")))


BOARD_QUALITY = """
WITH p AS (SELECT p_partkey AS k, k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 AS bad, k % 5 = 0 AS dash, k % 4 AS m FROM part WHERE p_partkey % 29 <> 0)
SELECT k AS source_row, CASE WHEN bad THEN 'invalid_row_shape' ELSE 'record' END AS outcome, CASE WHEN NOT bad THEN 'Ikeja' END AS city, CASE WHEN NOT bad AND NOT dash THEN 1200000::DOUBLE END AS annual_rate, CASE WHEN NOT bad THEN 100000.5::DOUBLE END AS monthly_rate,
  CASE WHEN NOT bad THEN ['month', 'combined', 'unparsed', 'quarter_only'][m + 1] END AS period, CASE WHEN NOT bad THEN concat_ws('|', 'year_from_artifact_context', CASE WHEN dash THEN 'missing_rate' END, CASE WHEN m = 2 THEN 'unparsed_period' END) END AS flags FROM p
"""


def accessible_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site_id"), (F.col("l_suppkey") % 3).alias("assertion_id"), F.when(F.col("l_returnflag") == "A", "walking").otherwise("mixed").alias("access_mode"), (F.col("l_linenumber") * 5).alias("threshold"), F.to_date("l_shipdate").alias("created_at"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("snapshot_id"),
    )
    return site_context.accessible_heads(rows).select("site_id", "access_mode", F.col("threshold").cast("long").alias("threshold"), "snapshot_id")


ACCESSIBLE_HEADS = """
SELECT l_suppkey AS site_id, CASE WHEN l_returnflag = 'A' THEN 'walking' ELSE 'mixed' END AS access_mode, (l_linenumber * 5)::BIGINT AS threshold, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS snapshot_id FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, access_mode, l_linenumber ORDER BY l_shipdate::DATE DESC, snapshot_id DESC) = 1
"""


def licence_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation the manifest of its suppliers."""
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return policies.manifest(rows, ["s_nationkey"], ["s_suppkey", "s_name"], ["s_suppkey"])


LICENCE_MANIFEST = """
SELECT s_nationkey, '[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']' AS manifest FROM supplier GROUP BY 1
"""


def licence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Features are orders, their sources the line items."""
    item = F.struct(F.col("l_returnflag").alias("dataset"), F.when(F.col("l_partkey") % 4 != 0, "cc-by").otherwise("").alias("license"))
    features = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("sources"))
    return policies.licence_coverage(features, "sources")


LICENCE_COVERAGE = """
WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_partkey % 4 <> 0) AS k FROM lineitem GROUP BY 1)
SELECT sum(n)::BIGINT AS n_items, sum(k)::BIGINT AS n_licensed, count(*) FILTER (WHERE n = k)::BIGINT AS n_whole, count(*)::BIGINT AS n_features FROM f
"""


def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    flags = F.array_compact(F.array(*[F.when(k % m == 0, name) for name, m in (("missing_rate", 3), ("unparsed_period", 5), ("superseded", 7))]))
    return policies.flag_counts(table(spark, sf, "lineitem").select(flags.alias("flags")), "flags")


FLAG_COUNTS = """
SELECT flag, count(*)::BIGINT AS n_rows FROM (SELECT unnest([CASE WHEN l_partkey % 3 = 0 THEN 'missing_rate' END, CASE WHEN l_partkey % 5 = 0 THEN 'unparsed_period' END, CASE WHEN l_partkey % 7 = 0 THEN 'superseded' END]) AS flag FROM lineitem) WHERE flag IS NOT NULL GROUP BY 1
"""

ENTRIES = {
    "constraint_checks": (constraint_checks, CONSTRAINT_CHECKS),
    "coordinate_assertions": (coordinate_assertions, COORDINATE_ASSERTIONS),
    "manual_alias_precedence": (manual_alias_precedence, MANUAL_ALIAS_PRECEDENCE),
    "alias_collisions": (alias_collisions, ALIAS_COLLISIONS),
    "updated_from": (updated_from, UPDATED_FROM),
    "activity_potential": (activity_potential, ACTIVITY_POTENTIAL),
    "claim_and_request_checks": (claim_and_request_checks, CLAIM_AND_REQUEST_CHECKS),
    "adjustment_options": (adjustment_options, ADJUSTMENT_OPTIONS),
    "plan_deltas": (plan_deltas, PLAN_DELTAS),
    "weight_months": (weight_months, WEIGHT_MONTHS),
    "board_quality": (board_quality, BOARD_QUALITY),
    "accessible_heads": (accessible_heads, ACCESSIBLE_HEADS),
    "licence_manifest": (licence_manifest, LICENCE_MANIFEST),
    "licence_coverage": (licence_coverage, LICENCE_COVERAGE),
    "flag_counts": (flag_counts, FLAG_COUNTS),
}


def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of the latest run's files, with six look-ups by type and literal, counted by what they found."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    k = F.col("l_suppkey")
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("src"), k % 4).alias("source_id"), F.concat(F.lit("sha"), F.col("l_partkey") % 3).alias("sha256"), F.col("o_orderpriority").alias("state"), F.col("l_returnflag").alias("city"), F.col("o_orderstatus").alias("category"),
        F.col("l_linestatus").alias("format_category"), F.concat(F.lit("s"), k % 10).alias("advertiser"), F.concat(F.lit("b"), F.col("l_partkey") % 10).alias("brand"),
    )
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    made = nations.select(F.concat(F.lit("run"), "n").alias("run_id"), F.when(F.col("n") % 4 == 3, "failed").otherwise("succeeded").alias("status"), F.when(F.col("n") % 5 != 0, F.col("n") % 7).alias("completed_at"))
    run_sources = nations.select(F.concat(F.lit("run"), "n").alias("run_id"), F.inline(F.array(*[F.struct(F.lit(f"src{s}").alias("source_id"), F.concat(F.lit("sha"), (F.col("n") + s) % 3).alias("sha256")) for s in range(3)])))
    literals = {"state": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), "city": ("A", "N"), "category": ("F", "O"), "format": ("F",), "advertiser": tuple(f"s{i}" for i in range(0, 10, 2)), "brand": tuple(f"b{i}" for i in range(7))}
    entries = [(v, t, s, f"{t}:{s}") for t, names in literals.items() for s in names for v in ("v1", "v2") if v == "v2" or s < "F"]
    aliases = spark.createDataFrame(entries, "resolver_version string, entity_type string, source_literal string, entity_id string")
    found = runs.with_entities(runs.of_run(facts, run_sources, runs.latest_run(made)), aliases, "v2")
    names = [f"{c}_entity_id" for c, _ in runs.LOOKUPS]
    return found.groupBy("source_id", "sha256").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(n).alias(n.replace("_entity_id", "_found")) for n in names])


FACT_ENTITIES = """
WITH r AS (SELECT n_nationkey AS n FROM nation WHERE n_nationkey % 4 <> 3 ORDER BY CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 7 END DESC NULLS LAST, 'run' || n_nationkey DESC LIMIT 1),
x AS (SELECT s, (n + s) % 3 AS h FROM r, (SELECT unnest([0, 1, 2]) AS s)),
f AS (SELECT l_suppkey % 4 AS s, l_partkey % 3 AS h, o_orderpriority AS p, l_returnflag AS c, o_orderstatus AS g, l_linestatus AS t, l_suppkey % 10 AS a, l_partkey % 10 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'src' || s AS source_id, 'sha' || h AS sha256, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE p IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))::BIGINT AS state_found, count(*) FILTER (WHERE c IN ('A', 'N'))::BIGINT AS city_found,
  count(*) FILTER (WHERE g IN ('F', 'O'))::BIGINT AS category_found, count(*) FILTER (WHERE t = 'F')::BIGINT AS format_category_found, count(*) FILTER (WHERE a % 2 = 0)::BIGINT AS advertiser_found, count(*) FILTER (WHERE b < 7)::BIGINT AS brand_found
FROM f JOIN x USING (s, h) GROUP BY ALL
"""


def context_bindings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    packages = table(spark, sf, "orders").select(k.alias("package_id"), (F.col("o_custkey") + F.when(k % 50 == 0, 10_000_000).otherwise(0)).alias("snapshot_id"), F.when(k % 17 == 0, "f2").otherwise("f1").alias("feature_version"), F.lit("v2").alias("resolver_version"), F.col("o_custkey").cast("string").alias("source_fingerprint"), F.when(k % 23 == 0, "x").alias("resolution_fingerprint"))
    snapshots = table(spark, sf, "customer").select(F.col("c_custkey").alias("snapshot_id"), F.lit("f1").alias("feature_version"), F.when(F.col("c_custkey") % 31 != 0, "v2").alias("resolver_version"), F.col("c_custkey").cast("string").alias("source_fingerprint"), F.lit(None).cast("string").alias("resolution_fingerprint"))
    return runs.binding_failures(packages, snapshots)


CONTEXT_BINDINGS = """
SELECT o_orderkey AS package_id, CASE WHEN o_orderkey % 50 = 0 OR c_custkey IS NULL THEN 'CALIBRATION_CONTEXT_SNAPSHOT_NOT_FOUND' ELSE 'CALIBRATION_CONTEXT_BINDING_MISMATCH' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 50 = 0 OR c_custkey IS NULL OR o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 OR c_custkey % 31 = 0
"""


def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit row of a run with three outputs."""
    found = runs.run_counts("run-1", {n: table(spark, sf, n) for n in ("orders", "nation", "supplier")})
    return found.select("run_id", "status", F.to_json("counts").alias("counts"))


RUN_AUDIT = """
SELECT 'run-1' AS run_id, 'succeeded' AS status, '{"nation":' || (SELECT count(*) FROM nation) || ',"orders":' || (SELECT count(*) FROM orders) || ',"supplier":' || (SELECT count(*) FROM supplier) || '}' AS counts
"""

ENTRIES |= {"fact_entities": (fact_entities, FACT_ENTITIES), "context_bindings": (context_bindings, CONTEXT_BINDINGS), "run_audit": (run_audit, RUN_AUDIT)}
