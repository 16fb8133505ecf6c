"""Briefs, eligibility, evidence, uploads, site context and survey signals over the given tables, each with its SQL.

Keys of the tables stand in for the facts that these rules judge; every query reads its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import briefs, delivery, evidence, policies, site_context, spatial, survey, uploads
from marquee.plans.governance import RESPONSES, _responses
from marquee.plans.warehouse import table

SECTORS = ("fmcg", "real_estate", "bank_fintech")
#: Texts of the briefs, by key.
ASKED = (
    "Campus students", "family households", "On-the-go shoppers", "Diaspora buyers abroad", "corporate executives", "landlords, students & investors", "SME owners", "young professionals 26-35",
    "luxury buyers", "everyone", "traders who ride danfo", "remote workers with low income", "university youth with private car",
)
PRODUCTS = ("instant noodles", "home loans for salaried staff", "ride-hailing app", "Café cards", "tricycle insurance", "BRT passes", "daily commuter data")


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def bare(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def brief_audience(spark: SparkSession, sf: str) -> DataFrame:
    """The audience of a brief per customer; a part of the sectors' cells is not offered."""
    k = F.col("c_custkey")
    sector = pick(SECTORS, k)
    cells = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c, _, _ in briefs.AUDIENCES])
    offered = F.transform(F.filter(cells, lambda x: (x["s"] == sector) & ((k % 10 != 0) | (x["c"] != "merchant_owner_users"))), lambda x: x["c"])
    rows = table(spark, sf, "customer").select(k, briefs.resolve_audience(sector, [pick(ASKED, k), pick(PRODUCTS, F.floor(k / 3).cast("long"))], offered).alias("a"))
    return rows.select("c_custkey", "a.mode", F.array_join("a.cell_ids", "|").alias("cells"), "a.label", F.array_join("a.signals", "|").alias("signals"))


_AUDIENCE_WORDS = ", ".join(f"({quoted(s)}, {i}, {quoted(c)}, {quoted(label)}, {j}, {quoted(w)}, {quoted(bare(w))})" for i, (s, c, label, words) in enumerate(briefs.AUDIENCES) for j, w in enumerate(words))
BRIEF_AUDIENCE = f"""
WITH w AS (SELECT * FROM (VALUES {_AUDIENCE_WORDS}) t(sector, i, cell, label, j, term, word)),
b AS (SELECT c_custkey, {listed(SECTORS)}[c_custkey % 3 + 1] AS sector, trim(regexp_replace(lower({listed(ASKED)}[c_custkey % {len(ASKED)} + 1] || ' ' || {listed(PRODUCTS)}[(c_custkey // 3) % {len(PRODUCTS)} + 1]), '[^a-z0-9]+', ' ', 'g')) AS text FROM customer),
o AS (SELECT c_custkey, sector, text, list_sort(list_distinct(list(cell))) AS cells FROM b JOIN w USING (sector) WHERE c_custkey % 10 <> 0 OR cell <> 'merchant_owner_users' GROUP BY ALL),
h AS (SELECT c_custkey, count(DISTINCT i) AS n, min(cell) AS cell, min(label) AS label, string_agg(term, '|' ORDER BY i, j) AS signals FROM b JOIN w USING (sector) WHERE contains(text, word) GROUP BY 1)
SELECT o.c_custkey, CASE WHEN n = 1 AND list_contains(cells, cell) THEN 'focused' ELSE 'sector_preset' END AS mode, CASE WHEN n = 1 AND list_contains(cells, cell) THEN cell ELSE array_to_string(cells, '|') END AS cells,
  CASE WHEN n = 1 AND list_contains(cells, cell) THEN label ELSE {{'fmcg': 'FMCG sector audience preset', 'real_estate': 'Real Estate sector audience preset', 'bank_fintech': 'Bank / Fintech sector audience preset'}}[sector] END AS label, coalesce(signals, '') AS signals
FROM o LEFT JOIN h USING (c_custkey)
"""
BRIEF_AUDIENCE = BRIEF_AUDIENCE.replace("{'fmcg': ", "MAP {'fmcg': ")

#: Segments that the catalogue of the query has.
CATALOGUE = ("ageBand=18-25", "ageBand=26-35", "incomeBand=₦200,000–₦499,999", "incomeBand=₦50,000–₦99,999", "occupation=Business/trader", "transportMode=Private car", "commutePattern=Daily commuter")


def survey_segments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    available = F.array(*[F.lit(c) for c in CATALOGUE])
    # A key is little to read and much to judge, so rows are dealt to tasks first.
    customers = table(spark, sf, "customer").select(k).repartition(spatial.tasks(spark))
    rows = briefs.with_segment(customers, [pick(ASKED, k), pick(PRODUCTS, F.floor(k / 3).cast("long"))], available, "s")
    return rows.select("c_custkey", "s.mode", "s.selected", "s.requested", *[F.array_join(f"s.{c}", "|").alias(c) for c in ("terms", "rules", "unavailable")])


_SEGMENT_WORDS = ", ".join(f"({i}, {quoted(n)}, {j}, {quoted(t)}, {quoted(' ' + bare(t) + ' ')})" for i, (n, terms, _) in enumerate(briefs.SEGMENTS) for j, t in enumerate(terms))
_SEGMENT_VALUES = ", ".join(f"({i}, {j}, {quoted(f'{d}={v}')})" for i, (_, _, pairs) in enumerate(briefs.SEGMENTS) for j, (d, v) in enumerate(pairs))
SURVEY_SEGMENTS = f"""
WITH w AS (SELECT * FROM (VALUES {_SEGMENT_WORDS}) t(i, name, j, term, word)), v AS (SELECT * FROM (VALUES {_SEGMENT_VALUES}) t(i, j, cand)),
b AS (SELECT c_custkey, ' ' || trim(regexp_replace(replace(lower({listed(ASKED)}[c_custkey % {len(ASKED)} + 1] || ' ' || {listed(PRODUCTS)}[(c_custkey // 3) % {len(PRODUCTS)} + 1]), 'é', 'e '), '[^a-z0-9]+', ' ', 'g')) || ' ' AS text FROM customer),
h AS (SELECT c_custkey, i, name, j, term FROM b, w WHERE contains(text, word)),
t AS (SELECT c_custkey, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT c_custkey, list(term ORDER BY i, j) AS list_distinct_ordered FROM (SELECT c_custkey, term, min(i) AS i, min_by(j, i * 100 + j) AS j FROM h GROUP BY ALL) GROUP BY 1)),
r AS (SELECT c_custkey, string_agg(name, '|' ORDER BY i) AS rules FROM (SELECT DISTINCT c_custkey, i, name FROM h) GROUP BY 1),
c AS (SELECT c_custkey, cand, min(i * 100 + j) AS o FROM (SELECT DISTINCT c_custkey, i FROM h) JOIN v USING (i) GROUP BY ALL),
s AS (SELECT c_custkey, min(o) AS first, min_by(cand, o) AS requested, min(o) FILTER (WHERE list_contains({listed(CATALOGUE)}, cand)) AS so, min_by(cand, o) FILTER (WHERE list_contains({listed(CATALOGUE)}, cand)) AS selected FROM c GROUP BY 1),
u AS (SELECT c_custkey, string_agg(cand, '|' ORDER BY o) AS unavailable FROM c JOIN s USING (c_custkey) WHERE so IS NULL OR o < so GROUP BY 1)
SELECT b.c_custkey, CASE WHEN first IS NULL THEN 'fallback_no_match' WHEN so IS NULL THEN 'fallback_suppressed' WHEN so = first THEN 'matched' ELSE 'matched_after_suppression' END AS mode, selected, requested,
  coalesce(terms, '') AS terms, coalesce(rules, '') AS rules, coalesce(unavailable, '') AS unavailable
FROM b LEFT JOIN s USING (c_custkey) LEFT JOIN t USING (c_custkey) LEFT JOIN r USING (c_custkey) LEFT JOIN u USING (c_custkey)
"""


def source_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """A scope per brand and sector, its targets the parts, the sources the suppliers."""
    s = F.col("s_suppkey")
    kinds = ("target_universe", "target_allocation", "influence", "serviceability")
    sources = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), s).alias("source_id"), pick(kinds, s).alias("kind"), pick(SECTORS, F.floor(s / 4).cast("long")).alias("sector"), F.when(s % 23 == 0, "abuja").otherwise("lagos").alias("geography"),
        F.when(s % 17 == 0, "other").otherwise(pick(SECTORS, F.floor(s / 4).cast("long"))).alias("product_scope"), F.lit("2026-01-01").alias("period_start"), F.when(s % 13 == 0, "2026-06-30").otherwise("2026-12-31").alias("period_end"),
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("x"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"), "p_retailprice")
    base = 12 * (F.col("b") % 8) + 4 * F.col("x")
    source = lambda n, odd: F.concat(F.lit("s"), F.when(odd, base + n + 12).otherwise(base + n).cast("long"))
    scope = F.concat_ws("/", "p_brand", pick(SECTORS, F.col("x")))
    targets = parts.select(scope.alias("scope_id"), source(0, F.col("p_partkey") % 97 == 0).alias("universe_source"), source(2, F.col("p_partkey") % 89 == 0).alias("qi_source"), source(3, F.lit(False)).alias("serviceability_source"))
    scopes = parts.select(
        scope.alias("scope_id"), pick(SECTORS, F.col("x")).alias("sector"), F.lit("lagos").alias("geography"), F.lit("2026-05-01").alias("flight_start"), F.lit("2026-07-31").alias("flight_end"), source(1, F.lit(False)).alias("allocation_source"),
        F.lit("linkage").alias("assumption"), F.when(F.col("b") % 5 == 0, "").otherwise("range").alias("sensitivity"),
    ).distinct()
    weights = parts.select(scope.alias("scope_id"), F.col("p_retailprice").alias("weight"), F.when(F.col("b") % 7 == 0, 0.0).otherwise(0.25).alias("qi"))
    return delivery.compatible_inputs(scopes, targets, sources, weights)


SOURCE_ELIGIBILITY = f"""
WITH src AS (SELECT 's' || s_suppkey AS source_id, ['target_universe', 'target_allocation', 'influence', 'serviceability'][s_suppkey % 4 + 1] AS kind, {listed(SECTORS)}[(s_suppkey // 4) % 3 + 1] AS sector, s_suppkey % 23 <> 0 AS here, s_suppkey % 17 <> 0 AS scoped, s_suppkey % 13 <> 0 AS spans FROM supplier),
p AS (SELECT p_partkey, p_brand, p_size % 3 AS x, b, 12 * (b % 8) + 4 * (p_size % 3) AS base, p_brand || '/' || {listed(SECTORS)}[p_size % 3 + 1] AS scope_id, {listed(SECTORS)}[p_size % 3 + 1] AS sector, p_retailprice FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS b FROM part)),
u AS (SELECT scope_id, sector, 'target_universe' AS wanted, 's' || (base + CASE WHEN p_partkey % 97 = 0 THEN 12 ELSE 0 END) AS source_id FROM p
  UNION ALL SELECT scope_id, sector, 'influence', 's' || (base + 2 + CASE WHEN p_partkey % 89 = 0 THEN 12 ELSE 0 END) FROM p UNION ALL SELECT scope_id, sector, 'serviceability', 's' || (base + 3) FROM p UNION ALL SELECT scope_id, sector, 'target_allocation', 's' || (base + 1) FROM p),
f AS (SELECT scope_id, wanted, u.source_id, coalesce(src.kind = wanted AND src.sector = u.sector AND here AND scoped AND spans, false) AS fits FROM u LEFT JOIN src USING (source_id)),
g AS (SELECT scope_id, bool_and(fits) FILTER (WHERE wanted = 'target_universe') AS a, bool_and(fits) FILTER (WHERE wanted = 'target_allocation') AS b, bool_and(fits) FILTER (WHERE wanted = 'serviceability') AND count(DISTINCT source_id) FILTER (WHERE wanted = 'serviceability') = 1 AS s,
  bool_and(fits) FILTER (WHERE wanted = 'influence') AND count(DISTINCT source_id) FILTER (WHERE wanted = 'influence') = 1 AS i FROM f GROUP BY 1),
m AS (SELECT scope_id, min(b) AS crc, sum(p_retailprice * CASE WHEN b % 7 = 0 THEN 0 ELSE 0.25 END) > 0 AS mass FROM p GROUP BY 1)
SELECT scope_id, a AS universe_ok, b AS allocation_ok, a AND b AS reach_ok, s AS serviceability_ok, i AND mass AND crc % 5 <> 0 AS influence_ok FROM g JOIN m USING (scope_id)
"""


def objective_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """What each order delivers: ceilings, panel failures, inputs and ranges follow from its key, the numbers from its price."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    highest = pick(delivery.CLAIMS, k)
    failure = F.when(k % 11 == 0, "SCALING_OUTSIDE_ENVELOPE")
    ok = {"reach": k % 13 != 0, "influence": k % 5 != 0, "serviceability": k % 7 != 0}
    numbers = {"target_chances": price * 3, "reach": price, "frequency": F.lit(3.0), "influence_mass": price * 0.3, "influence_capture": F.lit(30.0), "serviceable_reach": price * 0.6}
    rows = table(spark, sf, "orders").select(k, price, *[v.alias(n) for n, v in numbers.items()])
    shown = delivery.permitted_scenario(highest, failure, ok["influence"], ok["serviceability"])
    rows = rows.select("o_orderkey", "o_totalprice", *[v.alias(n) for n, v in shown.items()])
    spread = lambda c: F.array(F.col(c) * F.when(k % 17 == 0, 1.2).otherwise(0.8), F.col(c), F.col(c) * 1.1)
    claim = delivery.selected_claim(highest, spread("reach"), F.col("target_chances"), price * 5, price * 8, F.when(k % 3 != 0, k % 101))
    proof = {n: F.when(k % m != 0, "D") for n, m in (("reach", 31), ("influence", 37), ("serviceability", 41))}
    values = {"target_reach": spread("reach"), "influence_weighted_reached_mass": spread("influence_mass"), "serviceable_target_reach": spread("serviceable_reach")}
    found = delivery.objective_delivery(pick(tuple(delivery.METRICS), F.floor(k / 2).cast("long")), ok, claim["kind"], proof, values)
    return rows.select("o_orderkey", "failure", claim.alias("c"), found.alias("d")).select("o_orderkey", "failure", F.col("c.kind").alias("claim"), F.round("c.value", 4).alias("claim_value"), "d.metric", *[F.round(f"d.{x}", 4).alias(x) for x in ("low", "base", "high")], "d.reason")


OBJECTIVE_DELIVERY = f"""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderkey % 7 AS h, ['broad_reach', 'influential_core', 'near_conversion'][(o_orderkey // 2) % 3 + 1] AS objective FROM orders),
s AS (SELECT *, CASE WHEN h >= 5 AND k % 11 = 0 THEN 'SCALING_OUTSIDE_ENVELOPE' END AS failure, CASE WHEN h >= 4 THEN p * 3::DOUBLE END AS views, CASE WHEN h >= 5 AND k % 11 <> 0 THEN p END AS reach FROM o),
t AS (SELECT *, CASE WHEN k % 5 <> 0 THEN reach * 0.3::DOUBLE END AS mass, CASE WHEN k % 7 <> 0 THEN reach * 0.6::DOUBLE END AS serviceable FROM s),
c AS (SELECT *, CASE WHEN h >= 5 AND reach IS NOT NULL THEN 'scenario_target_reach' WHEN h >= 4 AND views IS NOT NULL THEN 'target_ots' WHEN h >= 3 THEN 'general_ots' WHEN h >= 2 THEN 'movement' WHEN h >= 1 AND k % 3 <> 0 THEN 'activity_potential' ELSE 'unavailable' END AS claim,
  CASE objective WHEN 'broad_reach' THEN reach WHEN 'influential_core' THEN mass ELSE serviceable END AS v FROM t),
r AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'TARGET_BASIS_INCOMPATIBLE' WHEN claim <> 'scenario_target_reach' OR k % 31 = 0 THEN 'UNIQUE_REACH_UNAVAILABLE' WHEN objective = 'influential_core' AND (k % 5 = 0 OR k % 37 = 0) THEN 'INFLUENCE_PROFILE_INCOMPATIBLE'
  WHEN objective = 'near_conversion' AND (k % 7 = 0 OR k % 41 = 0) THEN 'SERVICEABILITY_PROFILE_INCOMPATIBLE' WHEN v IS NULL THEN 'OBJECTIVE_DELIVERY_UNAVAILABLE' WHEN k % 17 = 0 THEN 'INCOHERENT_OBJECTIVE_RANGE' END AS reason FROM c)
SELECT k AS o_orderkey, failure, claim, round(CASE claim WHEN 'scenario_target_reach' THEN p WHEN 'target_ots' THEN views WHEN 'general_ots' THEN p * 5 WHEN 'movement' THEN p * 8 WHEN 'activity_potential' THEN (k % 101)::DOUBLE END, 4) AS claim_value,
  CASE objective WHEN 'broad_reach' THEN 'target_reach' WHEN 'influential_core' THEN 'influence_weighted_reached_mass' ELSE 'serviceable_target_reach' END AS metric,
  CASE WHEN reason IS NULL THEN round(v * CASE WHEN k % 17 = 0 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END, 4) END AS low, CASE WHEN reason IS NULL THEN round(v, 4) END AS base, CASE WHEN reason IS NULL THEN round(v * 1.1::DOUBLE, 4) END AS high, reason FROM r
"""


def calibration_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """An evidence package per order, its artifacts the line items."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    packages = orders.select(k.alias("package_id"), F.when(k % 29 != 0, F.timestamp_add("DAY", F.lit(60), F.col("day").cast("timestamp"))).alias("frozen_at"), (k % 3 != 0).alias("replicated"))
    n = F.col("l_linenumber")
    kinds = ("movement_truth", "movement_truth", "exposure_geometry_truth", "target_panel_truth", "downstream_validation_result", "movement_truth", "movement_truth")
    usages = ("training", "held_out_validation", "held_out_validation", "held_out_validation", "held_out_validation", "independent_date_replication", "training")
    day = lambda c: F.date_format(F.to_date(c), "yyyy-MM-dd")
    artifacts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("package_id"), F.when(F.col("l_partkey") % 19 == 0, "same").otherwise(n.cast("string")).alias("artifact_id"), F.concat(F.lit("sha"), F.col("l_partkey") % 500).alias("sha256"), pick(kinds, n - 1).alias("kind"), pick(usages, n - 1).alias("usage"),
        F.when(F.col("l_suppkey") % 50 == 0, "ftp://x/y").otherwise("s3://x/y").alias("provenance_uri"), F.lit("https://x/z").alias("retained_uri"), F.when(F.col("l_partkey") % 37 == 0, " TBD ").otherwise("cc-by").alias("license_id"),
        F.when(F.col("l_partkey") % 101 == 0, "").otherwise("review-1").alias("rights_ref"), day("l_shipdate").alias("period_start"), F.when(F.col("l_suppkey") % 31 == 0, "2023-02-30").otherwise(day(F.date_add(F.to_date("l_shipdate"), 9))).alias("period_end"),
    )
    share = lambda m: (k % m) / 100.0
    reports = orders.select(
        k.alias("package_id"), F.when(k % 4 == 0, "test_fixture").otherwise("production_reviewed").alias("environment"), (k % 9).alias("held_out_locations"), (190 + k % 40).alias("directional_blocks"), share(41).alias("mdape"), share(43).alias("wape"),
        (1 - share(37)).alias("interval_coverage"), share(17).alias("absolute_signed_wape"), share(27).alias("worst_stratum_signed_wape"), (k % 8 != 0).alias("independent_date_replication"), (k % 14 != 0).alias("claim_inputs_complete"),
        (k % 22 != 0).alias("inside_applicability_envelope"), (k % 25 != 0).alias("downstream_protocol_registered"),
    )
    found = evidence.promotion(evidence.package_failures(packages, artifacts), reports)
    return found.select("package_id", "package_valid", "calibration_passed", "eligible", F.array_join("package_failures", "|").alias("package_failures"), "fixture", F.array_join("calibration_failures", "|").alias("calibration_failures"))


CALIBRATION_PROMOTION = """
WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE + INTERVAL 60 DAY AS frozen FROM orders),
a AS (SELECT l_orderkey AS k, CASE WHEN l_partkey % 19 = 0 THEN 'same' ELSE l_linenumber::VARCHAR END AS id, l_partkey % 500 AS sha, ['m', 'm', 'e', 't', 'd', 'm', 'm'][(l_linenumber - 1) % 7 + 1] AS kind, ['t', 'h', 'h', 'h', 'h', 'i', 't'][(l_linenumber - 1) % 7 + 1] AS usage,
  l_suppkey % 50 <> 0 AND l_partkey % 37 <> 0 AS ok, l_partkey % 101 <> 0 AS whole, l_suppkey % 31 <> 0 AS period, l_shipdate::DATE AS d FROM lineitem),
f AS (SELECT k, bool_and(whole) AS whole, bool_and(period) AS periods, bool_and(ok) AS ok, bool_or(kind = 'm' AND usage = 't') AS x1, bool_or(kind = 'm' AND usage = 'h') AS x2, bool_or(kind = 'e' AND usage = 'h') AS x3, bool_or(kind = 't' AND usage = 'h') AS x4, bool_or(kind = 'd' AND usage = 'h') AS x5,
  bool_or(kind = 'm' AND usage = 'i') AS x6, min(d) FILTER (WHERE kind = 'm' AND usage = 'i') AS d6, count(*) <> count(DISTINCT id) AS dup FROM a GROUP BY 1),
c AS (SELECT k, max(n) > 1 AS collision FROM (SELECT k, sha, count(DISTINCT usage) AS n FROM a GROUP BY ALL) GROUP BY 1),
p AS (SELECT o.k, CASE WHEN NOT coalesce(whole, false) THEN 'INVALID_PACKAGE_SCHEMA' ELSE concat_ws('|', CASE WHEN o.k % 29 = 0 THEN 'INVALID_MODEL_FREEZE_TIME' END, CASE WHEN NOT periods THEN 'ARTIFACT_PERIOD_INVALID' END, CASE WHEN NOT ok THEN 'UNREVIEWED_PROVENANCE_OR_RIGHTS' END,
  CASE WHEN dup THEN 'DUPLICATE_ARTIFACT_ID' END, CASE WHEN collision THEN 'ARTIFACT_ROLE_COLLISION' END, CASE WHEN NOT x1 THEN 'MISSING_TRAINING_MOVEMENT_TRUTH' END, CASE WHEN NOT x2 THEN 'MISSING_HELD_OUT_MOVEMENT_TRUTH' END, CASE WHEN NOT x3 THEN 'MISSING_HELD_OUT_EXPOSURE_GEOMETRY_TRUTH' END,
  CASE WHEN NOT x4 THEN 'MISSING_HELD_OUT_TARGET_PANEL_TRUTH' END, CASE WHEN NOT x5 THEN 'MISSING_DOWNSTREAM_VALIDATION_RESULT' END, CASE WHEN o.k % 3 <> 0 AND NOT x6 THEN 'MISSING_INDEPENDENT_DATE_REPLICATION_EVIDENCE' END, CASE WHEN o.k % 29 <> 0 AND d6 <= frozen THEN 'INDEPENDENT_DATE_NOT_POST_FREEZE' END) END AS pf
  FROM o LEFT JOIN f USING (k) LEFT JOIN c USING (k)),
g AS (SELECT k, pf, CASE WHEN pf = 'INVALID_PACKAGE_SCHEMA' THEN '' ELSE concat_ws('|', CASE WHEN k % 9 < 3 THEN 'HELD_OUT_LOCATIONS' END, CASE WHEN 190 + k % 40 < 192 THEN 'DIRECTIONAL_BLOCKS' END, CASE WHEN k % 8 = 0 THEN 'INDEPENDENT_DATE_REPLICATION' END, CASE WHEN k % 41 > 35 THEN 'MDAPE' END,
  CASE WHEN k % 43 > 35 THEN 'WAPE' END, CASE WHEN k % 37 > 30 THEN 'INTERVAL_COVERAGE' END, CASE WHEN k % 17 > 15 THEN 'SIGNED_WAPE' END, CASE WHEN k % 27 > 25 THEN 'STRATUM_BIAS' END, CASE WHEN k % 14 = 0 THEN 'CLAIM_INPUTS' END, CASE WHEN k % 22 = 0 THEN 'APPLICABILITY' END, CASE WHEN k % 25 = 0 THEN 'DOWNSTREAM_PROTOCOL' END) END AS cf FROM p)
SELECT k AS package_id, pf = '' AS package_valid, pf <> 'INVALID_PACKAGE_SCHEMA' AND cf = '' AS calibration_passed, pf = '' AND cf = '' AND k % 4 <> 0 AS eligible, pf AS package_failures, pf <> 'INVALID_PACKAGE_SCHEMA' AND k % 4 = 0 AS fixture, cf AS calibration_failures FROM g
"""

_LON, _LAT = "3.2::DOUBLE + (({k} * 37) % 101)::DOUBLE / 250::DOUBLE", "6.4::DOUBLE + (({k} * 53) % 97)::DOUBLE / 250::DOUBLE"


def upload_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as uploaded faces against a package of five of them and three zones."""
    k = F.col("p_partkey")
    lon, lat = 3.2 + ((k * 37) % 101) / 250.0, 6.4 + ((k * 53) % 97) / 250.0
    rows = table(spark, sf, "part").select(
        k.cast("string").alias("asset_id"), F.when(k % 6 != 0, F.col("p_brand")).alias("supplier"), F.when(k % 4 != 0, F.col("p_name")).otherwise("").alias("address"), F.when(k % 9 != 0, pick((" Digital LED", "static 48", "Wall", ""), k)).alias("format"),
        F.when(k % 8 != 0, F.col("p_retailprice")).alias("rate"), F.when(k % 5 != 0, lon).alias("lon"), F.when(k % 5 != 0, lat).alias("lat"),
    )
    package = table(spark, sf, "part").where(k <= 5).select(F.when(k % 2 == 0, "DOOH").otherwise("Static billboard").alias("format"), F.col("p_retailprice").alias("rate"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone_id"), F.lit(x).alias("lon"), F.lit(y).alias("lat")) for z, x, y in (("ikeja", 3.35, 6.6), ("vi", 3.42, 6.43), ("yaba", 3.38, 6.51))])
    found = uploads.comparison(rows, package, zones)
    return found.select("asset_id", "zone_id", F.round("distance_km", 6).alias("distance_km"), "format_fit", F.round("rate_delta_percent", 6).alias("rate_delta_percent"), F.round("completeness", 6).alias("completeness"))


UPLOAD_COMPARISON = f"""
WITH u AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN [' Digital LED', 'static 48', 'Wall', ''][p_partkey % 4 + 1] END AS format, CASE WHEN p_partkey % 8 <> 0 THEN p_retailprice END AS rate, CASE WHEN p_partkey % 5 <> 0 THEN {_LON.format(k='p_partkey')} END AS lon, CASE WHEN p_partkey % 5 <> 0 THEN {_LAT.format(k='p_partkey')} END AS lat FROM part),
z AS (SELECT * FROM (VALUES ('ikeja', 3.35::DOUBLE, 6.6::DOUBLE), ('vi', 3.42::DOUBLE, 6.43::DOUBLE), ('yaba', 3.38::DOUBLE, 6.51::DOUBLE)) t(zone_id, zx, zy)),
d AS (SELECT k, zone_id, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(zy - lat) / 2), 2) + cos(radians(lat)) * cos(radians(zy)) * pow(sin(radians(zx - lon) / 2), 2))) AS km FROM u, z WHERE lon IS NOT NULL),
n AS (SELECT k, min(km) AS km, arg_min(zone_id, (km, zone_id)) AS zone_id FROM d GROUP BY 1),
m AS (SELECT median(p_retailprice) AS med FROM part WHERE p_partkey <= 5)
SELECT u.k::VARCHAR AS asset_id, zone_id, round(km, 6) AS distance_km, CASE WHEN format IS NULL OR format = '' THEN 'unknown' WHEN format IN (' Digital LED', 'static 48') AND (format = 'static 48' OR true) THEN CASE format WHEN ' Digital LED' THEN 'matches_package' ELSE @STATIC@ END ELSE 'new_format' END AS format_fit,
  CASE WHEN med <> 0 THEN round(100 * (rate - med) / med, 6) END AS rate_delta_percent,
  round(((k % 6 <> 0)::INT + (k % 4 <> 0)::INT + coalesce((format <> '')::INT, 0) + (k % 8 <> 0)::INT + (k % 5 <> 0)::INT)::DOUBLE / 5, 6) AS completeness
FROM u LEFT JOIN n USING (k), m
""".replace("@STATIC@", "'matches_package'").replace(" AND (format = 'static 48' OR true)", "")


def _site_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Context rows per supplier: three radii a family, with metrics from its line items."""
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").where(n <= 3).groupBy(F.col("l_suppkey").alias("site_id"), n.alias("radius")).agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("m"))
    key = F.col("site_id")
    families = F.explode(F.array(*[F.lit(f) for f in site_context.FAMILIES])).alias("family")
    rows = rows.select("site_id", F.col("site_id").alias("assertion_id"), families, F.concat((F.col("radius") * 500).cast("string"), F.lit(" m")).alias("basis"), "radius", "c", "q", "m")
    vector, raster, settled = (F.col("family") == f for f in site_context.FAMILIES)
    partial = (vector & (key % 7 == 0)) | (raster & (key % 9 == 0)) | (settled & (key % 11 == 0))
    rows = rows.where(~(raster & (key % 6 == 0)))
    return rows.select(
        "site_id", "assertion_id", "family", "basis", (~(partial & (F.col("radius") == 2))).alias("covered"), F.when(vector, F.col("c")).alias("place_count"), F.when(vector & (key % 4 != 0), F.round(F.ln("q"), 6)).alias("taxonomy_entropy"),
        F.when(vector, F.col("m")).alias("nearest_major_road_m"), F.when(vector, F.col("q")).alias("major_road_density"), F.when(raster, F.col("q")).alias("population"), F.when(raster & (key % 5 != 0), F.col("c")).alias("accessible_population"),
        F.when(settled, F.col("m")).alias("settled_area_share"), F.when(settled & (key % 3 != 0), F.col("q")).alias("core_depth_m"), F.when(settled, F.col("c")).alias("component_density"),
    )


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_suppkey").alias("assertion_id"), (F.col("s_suppkey") % 13 != 0).alias("eligible"))


SITE_ROWS = """
l AS (SELECT l_suppkey AS k, l_linenumber AS r, count(*) AS c, sum(l_quantity) AS q, max(l_quantity) AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
x AS (SELECT k, (r * 500) || ' m' AS basis, r, c, q, m, f FROM l, (SELECT unnest(['vector', 'raster', 'settlement']) AS f) WHERE NOT (f = 'raster' AND k % 6 = 0)),
w AS (SELECT *, NOT (r = 2 AND ((f = 'vector' AND k % 7 = 0) OR (f = 'raster' AND k % 9 = 0) OR (f = 'settlement' AND k % 11 = 0))) AS covered FROM x)
"""


def site_read_model(spark: SparkSession, sf: str) -> DataFrame:
    model = site_context.read_model(_sites(spark, sf), _site_rows(spark, sf))
    return model.select("site_id", "eligible", *[F.coalesce(F.size(f), F.lit(0)).alias(f"n_{f}") for f in site_context.FAMILIES], *[f"{f}_missing" for f in site_context.FAMILIES])


SITE_READ_MODEL = f"""
WITH {SITE_ROWS}, n AS (SELECT k, f, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT s_suppkey AS k, s_suppkey % 13 <> 0 AS e FROM supplier)
SELECT s.k AS site_id, e AS eligible, coalesce(v.n, 0)::INT AS n_vector, coalesce(r.n, 0)::INT AS n_raster, coalesce(t.n, 0)::INT AS n_settlement,
  CASE WHEN NOT e THEN 'coordinate_not_currently_eligible' WHEN v.n IS NULL THEN 'not_derived' END AS vector_missing, CASE WHEN NOT e THEN 'coordinate_not_currently_eligible' WHEN r.n IS NULL THEN 'not_derived' END AS raster_missing,
  CASE WHEN NOT e THEN 'coordinate_not_currently_eligible' WHEN t.n IS NULL THEN 'not_derived' END AS settlement_missing
FROM s LEFT JOIN n v ON v.k = s.k AND v.f = 'vector' LEFT JOIN n r ON r.k = s.k AND r.f = 'raster' LEFT JOIN n t ON t.k = s.k AND t.f = 'settlement'
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("left_id"), (F.col("s_suppkey") + 1).alias("right_id"))


def site_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier beside the next one: why the comparison is incomplete."""
    found = site_context.compared(_pairs(spark, sf), site_context.read_model(_sites(spark, sf), _site_rows(spark, sf)))
    return found.select("left_id", "right_id", "complete", F.array_join("reasons", "|").alias("reasons"))


SITE_COMPARISON = f"""
WITH {SITE_ROWS}, n AS (SELECT k, count(*) FILTER (WHERE f = 'vector') AS v, count(*) FILTER (WHERE f = 'raster') AS r, count(*) FILTER (WHERE f = 'settlement') AS t, coalesce(bool_or(NOT covered) FILTER (WHERE f = 'vector'), false) AS pv, coalesce(bool_or(NOT covered) FILTER (WHERE f = 'raster'), false) AS pr,
  coalesce(bool_or(NOT covered) FILTER (WHERE f = 'settlement'), false) AS pt FROM w GROUP BY 1),
s AS (SELECT s_suppkey AS k, s_suppkey % 13 <> 0 AS e, coalesce(pv, false) AS pv, coalesce(pr, false) AS pr, coalesce(pt, false) AS pt, CASE WHEN s_suppkey % 13 = 0 THEN 'coordinate_not_currently_eligible' WHEN coalesce(v, 0) = 0 THEN 'not_derived' END AS mv,
  CASE WHEN s_suppkey % 13 = 0 THEN 'coordinate_not_currently_eligible' WHEN coalesce(r, 0) = 0 THEN 'not_derived' END AS mr, CASE WHEN s_suppkey % 13 = 0 THEN 'coordinate_not_currently_eligible' WHEN coalesce(t, 0) = 0 THEN 'not_derived' END AS mt FROM supplier LEFT JOIN n ON n.k = s_suppkey),
p AS (SELECT a.k AS left_id, b.k AS right_id, concat_ws('|', CASE WHEN NOT a.e THEN 'left_coordinate_not_currently_eligible' END, CASE WHEN NOT b.e THEN 'right_coordinate_not_currently_eligible' END,
  CASE WHEN a.mv IS NOT NULL OR b.mv IS NOT NULL THEN 'vector:' || coalesce(a.mv, 'available') || ':' || coalesce(b.mv, 'available') END, CASE WHEN a.mr IS NOT NULL OR b.mr IS NOT NULL THEN 'raster:' || coalesce(a.mr, 'available') || ':' || coalesce(b.mr, 'available') END,
  CASE WHEN a.mt IS NOT NULL OR b.mt IS NOT NULL THEN 'settlement:' || coalesce(a.mt, 'available') || ':' || coalesce(b.mt, 'available') END, CASE WHEN a.pv THEN 'left_vector_partial_coverage' END, CASE WHEN b.pv THEN 'right_vector_partial_coverage' END,
  CASE WHEN a.pr THEN 'left_raster_partial_coverage' END, CASE WHEN b.pr THEN 'right_raster_partial_coverage' END, CASE WHEN a.pt THEN 'left_settlement_partial_coverage' END, CASE WHEN b.pt THEN 'right_settlement_partial_coverage' END) AS reasons FROM s a JOIN s b ON b.k = a.k + 1)
SELECT left_id, right_id, reasons = '' AS complete, reasons FROM p
"""


def site_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    sites = _sites(spark, sf).where("eligible").select("site_id")
    pairs = _pairs(spark, sf).join(sites.select(F.col("site_id").alias("left_id")), "left_id", "left_semi").join(sites.select(F.col("site_id").alias("right_id")), "right_id", "left_semi")
    return site_context.contrasts(pairs, _site_rows(spark, sf))


SITE_CONTRASTS = f"""
WITH {SITE_ROWS},
v AS (SELECT k, f, basis, unnest([{{'metric': 'destination_presence', 'value': c::DOUBLE, 'lower': false}}, {{'metric': 'destination_diversity', 'value': CASE WHEN k % 4 <> 0 THEN round(ln(q), 6) END, 'lower': false}}, {{'metric': 'nearest_major_road_distance_m', 'value': m::DOUBLE, 'lower': true}},
    {{'metric': 'major_road_density_km_per_km2', 'value': q::DOUBLE, 'lower': false}}]) AS x FROM w WHERE covered AND f = 'vector'
  UNION ALL SELECT k, f, basis, unnest([{{'metric': 'resident_population', 'value': q::DOUBLE, 'lower': false}}, {{'metric': 'accessible_population', 'value': CASE WHEN k % 5 <> 0 THEN c::DOUBLE END, 'lower': false}}]) FROM w WHERE covered AND f = 'raster'
  UNION ALL SELECT k, f, basis, unnest([{{'metric': 'settled_area_share', 'value': m::DOUBLE, 'lower': false}}, {{'metric': 'settlement_core_depth', 'value': CASE WHEN k % 3 <> 0 THEN q::DOUBLE END, 'lower': false}}, {{'metric': 'settlement_component_density', 'value': c::DOUBLE, 'lower': false}}]) FROM w WHERE covered AND f = 'settlement'),
e AS (SELECT k, f, basis, x.metric AS metric, x.value AS value, x.lower AS lower FROM v WHERE k % 13 <> 0 AND x.value IS NOT NULL),
p AS (SELECT a.k AS left_id, b.k AS right_id, a.f AS family, a.metric, a.basis, a.value AS l, b.value AS r, a.lower FROM e a JOIN e b ON b.k = a.k + 1 AND a.f = b.f AND a.basis = b.basis AND a.metric = b.metric WHERE a.k IN (SELECT s_suppkey FROM supplier) AND b.k IN (SELECT s_suppkey FROM supplier))
SELECT left_id, right_id, family, metric, basis, CASE WHEN abs(l - r) / greatest(abs(l), abs(r), 1e-9) <= 0.05::DOUBLE THEN 'similar' WHEN (l > r) AND NOT lower THEN 'left_higher' WHEN NOT lower THEN 'right_higher' WHEN l > r THEN 'right_lower' ELSE 'left_lower' END AS direction, l AS left_value, r AS right_value FROM p
"""


def survey_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return survey.distribution(_responses(spark, sf), ["segment", "balance"], "event_type")


SURVEY_DISTRIBUTION = f"""
WITH {RESPONSES}, c AS (SELECT segment, balance, event_type AS category, count(*) AS n FROM r WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT segment, balance, category, n::BIGINT AS numerator, d::BIGINT AS denominator, CASE WHEN d >= 30 THEN floor(n / d * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE END AS share FROM (SELECT *, sum(n) OVER (PARTITION BY segment, balance) AS d FROM c)
"""

_METRICS = ("format.overall.led", "format.overall.static", "environment.mall", "environment.road", "memorability.music", "memorability.humour", "format.led.trust", "format.static.trust", "recall.four_week", "action.searched_online", "action.purchased_product_or_service")


def survey_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of each objective per customer segment, from metrics made of line items' keys."""
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("scope"), pick(_METRICS, F.col("c_custkey")).alias("metric"), "c_acctbal")
    metrics = rows.groupBy("scope", "metric").agg(F.count(F.lit(1)).alias("denominator"), (F.count_if(F.col("c_acctbal") > 4000) / F.count(F.lit(1))).alias("value"))
    metrics = metrics.withColumn("suppressed", F.col("denominator") < 3)
    found = None
    for objective in survey.SIGNALS:
        part = survey.signals(metrics, ["scope"], objective).withColumn("objective", F.lit(objective))
        found = part if found is None else found.unionByName(part)
    return found.select("objective", "scope", F.col("place").cast("long").alias("place"), "label", "metric", F.round("value", 6).alias("value"), "denominator", "text")


_SIGNAL_ROWS = ", ".join(f"({quoted(o)}, {i}, {quoted(label)}, {quoted(p)})" for o, parts in survey.SIGNALS.items() for i, (label, p) in enumerate(parts, 1))
SURVEY_SIGNALS = f"""
WITH g AS (SELECT c_mktsegment AS scope, {listed(_METRICS)}[c_custkey % {len(_METRICS)} + 1] AS metric, count(*) AS d, count(*) FILTER (WHERE c_acctbal > 4000) / count(*)::DOUBLE AS v FROM customer GROUP BY ALL),
s AS (SELECT * FROM (VALUES {_SIGNAL_ROWS}) t(objective, place, label, pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY objective, place, scope ORDER BY v DESC, metric) AS n FROM s JOIN g ON regexp_matches(metric, pattern) WHERE d >= 3)
SELECT objective, scope, place::BIGINT AS place, label, metric, round(v, 6) AS value, d::BIGINT AS denominator, CASE WHEN starts_with(metric, 'format.') THEN printf('%.2f / 5', v) ELSE (floor(v * 100 + 0.5::DOUBLE)::BIGINT)::VARCHAR || '%' END AS text FROM r WHERE n = 1
"""


def segment_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    people = _responses(spark, sf).select(F.when(F.col("balance") == "positive", "Lagos").otherwise("Abuja").alias("city"), "segment", "event_type")
    return survey.segment_catalogue(people, "Lagos", ["segment", "event_type"])


SEGMENT_CATALOGUE = f"""
WITH {RESPONSES}, u AS (SELECT 'segment' AS dimension, segment AS value FROM r WHERE balance = 'positive' UNION ALL SELECT 'event_type', event_type FROM r WHERE balance = 'positive')
SELECT dimension, value, count(*)::BIGINT AS sample_size, dimension || '=' || value AS profile FROM u WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
"""


def field_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fields of orders may be shown, per surface and purpose."""
    k = F.col("o_orderkey")
    policy = F.struct(
        pick(("KEEP", "DELETE_AT", "APPROVED_DERIVED_VALUE"), k).alias("persistence"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 60).cast("int")).alias("expires_at"), F.when(k % 5 == 0, F.array(F.lit("GOOGLE"))).otherwise(F.array(F.lit("GOOGLE"), F.lit("MAPLIBRE"))).alias("surfaces"),
        F.when(k % 7 == 0, F.array(F.lit("internal"))).otherwise(F.array(F.lit("display"), F.lit("internal"))).alias("purposes"), pick(("open.places", "google.places-aggregate.v1", "google.geocode"), F.floor(k / 3).cast("long")).alias("product"),
        pick(("OPEN", "GOOGLE_POI_COUNT", "GOOGLE_MAPS_CONTENT"), F.floor(k / 2).cast("long")).alias("content_class"), F.when(k % 4 != 0, "a").alias("attribution_id"), F.when(k % 3 != 0, "l").alias("legal_approval_id"), F.when(k % 6 == 0, "m").otherwise("l").alias("approval_id"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", policy.alias("p"))
    now = F.lit("2026-02-01").cast("date")
    return rows.select("o_orderkey", policies.renderable(F.col("p"), F.lit("MAPLIBRE"), now).alias("open_map"), policies.renderable(F.col("p"), F.lit("GOOGLE"), now).alias("own_map"), policies.projectable(F.col("p"), F.lit("GOOGLE"), F.lit("display"), now).alias("own_map_display"))


FIELD_POLICIES = """
WITH p AS (SELECT o_orderkey AS k, ['KEEP', 'DELETE_AT', 'APPROVED_DERIVED_VALUE'][o_orderkey % 3 + 1] AS keep, DATE '2026-01-01' + (o_orderkey % 60)::INT AS ex, o_orderkey % 5 <> 0 AS on_open, o_orderkey % 7 <> 0 AS disp, ['open.places', 'google.places-aggregate.v1', 'google.geocode'][(o_orderkey // 3) % 3 + 1] AS product,
  ['OPEN', 'GOOGLE_POI_COUNT', 'GOOGLE_MAPS_CONTENT'][(o_orderkey // 2) % 3 + 1] AS cc, o_orderkey % 4 <> 0 AS attr, o_orderkey % 3 <> 0 AND o_orderkey % 6 <> 0 AS appr FROM orders),
q AS (SELECT *, NOT (keep = 'DELETE_AT' AND ex <= DATE '2026-02-01') AS live, (cc <> 'GOOGLE_MAPS_CONTENT' OR attr) AS attributed FROM p)
SELECT k AS o_orderkey, live AND on_open AND CASE WHEN starts_with(product, 'google.') THEN product = 'google.places-aggregate.v1' AND cc = 'GOOGLE_POI_COUNT' AND keep = 'APPROVED_DERIVED_VALUE' AND appr ELSE cc <> 'GOOGLE_MAPS_CONTENT' END AS open_map,
  live AND attributed AS own_map, live AND attributed AND disp AS own_map_display FROM q
"""

ENTRIES = {
    "brief_audience": (brief_audience, BRIEF_AUDIENCE),
    "survey_segments": (survey_segments, SURVEY_SEGMENTS),
    "source_eligibility": (source_eligibility, SOURCE_ELIGIBILITY),
    "objective_delivery": (objective_delivery, OBJECTIVE_DELIVERY),
    "calibration_promotion": (calibration_promotion, CALIBRATION_PROMOTION),
    "upload_comparison": (upload_comparison, UPLOAD_COMPARISON),
    "site_read_model": (site_read_model, SITE_READ_MODEL),
    "site_comparison": (site_comparison, SITE_COMPARISON),
    "site_contrasts": (site_contrasts, SITE_CONTRASTS),
    "survey_distribution": (survey_distribution, SURVEY_DISTRIBUTION),
    "survey_signals": (survey_signals, SURVEY_SIGNALS),
    "segment_catalogue": (segment_catalogue, SEGMENT_CATALOGUE),
    "field_policies": (field_policies, FIELD_POLICIES),
}
