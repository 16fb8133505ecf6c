"""Planner queries over an inventory that the given tables make up: a face for each supplier, a zone for each nation, and a panel of customers by nation and segment."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans import planner
from marquee.plans.planner import BRIEFS, DAYPART_FACTORS, SCENARIOS, SECTORS, TARGETS, WEIGHTS, Brief, Bundle
from marquee.plans.warehouse import table
from marquee.sources.literal import literal_table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: A face whose movement is beyond the panel's envelope.
BUSY, BUSY_TIMES = 10, 1000


def _literal(values: list, kind: pa.DataType, name: str, spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"i": list(range(len(values))), name: values}, {"i": pa.int32(), name: kind})


def supplier_bundle(spark: SparkSession, sf: str) -> Bundle:
    """Rates follow suppliers' balances, movement their line items, and panel weights the numbers of customers."""
    k, z = F.col("k"), F.col("z")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("z"), "s_acctbal")
    suppliers = suppliers.withColumns({"site_id": F.concat(F.lit("site-"), k.cast("string")), "zone_id": F.concat(F.lit("zone-"), F.lpad(z.cast("string"), 2, "0"))})
    dooh = k % 3 == 0
    sites = suppliers.select(
        "site_id", "zone_id", k.cast("int").alias("site_ord"), F.concat(F.lit("supplier-"), k % 12).alias("supplier_id"), F.when(dooh, "dooh").otherwise("static").alias("format"),
        (F.lit(2_000_000.0) + F.round(F.abs("s_acctbal")) * 400).alias("rate"), (F.lit(0.44) + 0.06 * (k % 4)).alias("visibility"), F.when(dooh, 0.9).otherwise(1.0).alias("uptime"),
        F.when(dooh, 0.2).otherwise(1.0).alias("share_of_time"), F.lit(True).alias("available"), F.lit("2026-01-01").cast("date").alias("available_from"), F.lit("2027-12-31").cast("date").alias("available_to"),
    )
    parts = F.inline(F.array(*[F.struct(F.lit(d).alias("daypart"), F.lit(x).alias("x")) for d, x in DAYPART_FACTORS]))
    items = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counted = suppliers.join(items, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)) * F.when(k % BUSY == 0, BUSY_TIMES).otherwise(1))
    movement = counted.select("site_id", "n", parts).select("site_id", "daypart", (F.col("n") * 10.0 * F.col("x")).alias("base_movement"))
    sector_of, cell, _, qi, service = (list(x) for x in zip(*TARGETS))
    number, real, word = pa.int32(), pa.float64(), pa.string()
    targets = literal_table(
        spark,
        {"t": list(range(9)), "s": [SECTORS.index(x) for x in sector_of], "c": [t % 3 for t in range(9)], "sector": sector_of, "cell_id": cell, "qi": qi, "serviceability": service},
        {"t": number, "s": number, "c": number, "sector": word, "cell_id": word, "qi": real, "serviceability": real},
    )
    share = (F.lit(0.16) + 0.045 * ((z + F.col("s") + F.col("c") + k % 2) % 5)).alias("share")
    shares = suppliers.join(F.broadcast(targets)).select("site_id", "sector", "cell_id", F.col("c").alias("cell_ord"), share)
    s = F.col("s")
    sectors = F.inline(F.array(*[F.struct(F.lit(n).alias("sector"), F.lit(i).alias("s")) for i, n in enumerate(SECTORS)]))
    scores = suppliers.select("site_id", "k", "z", sectors).select(
        "site_id", "sector", (55.0 + 5 * ((k + 3 * s) % 8)).alias("A"), (50.0 + 5 * ((2 * k + s) % 9)).alias("C"), (58.0 + 5 * ((z + s) % 7)).alias("P"), (52.0 + 5 * ((k + s) % 8)).alias("E")
    )
    segment = F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("c_mktsegment")) - 1
    groups = table(spark, sf, "customer").groupBy((F.col("c_nationkey") * 5 + segment).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    j = F.col("j")
    member = groups.join(F.broadcast(targets), j % 3 == F.col("c")).withColumn("member_id", F.concat_ws("-", "sector", j.cast("string")))
    zones = F.inline(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda x: F.struct(x.alias("zone"))))
    dayparts = F.inline(F.array(*[F.struct(F.lit(n).alias("daypart"), F.lit(i + 1).alias("d")) for i, (n, _) in enumerate(DAYPART_FACTORS)]))
    affinity = member.select("member_id", "j", "t", zones).select("member_id", "j", "t", "zone", dayparts).select(
        "member_id", F.concat(F.lit("zone-"), F.lpad(F.col("zone").cast("string"), 2, "0")).alias("zone_id"), "daypart",
        (F.lit(0.55) + ((7 * j + 3 * F.col("zone") + F.col("t")) % 13) / 10).alias("zone_affinity"), (F.lit(0.70) + ((5 * j + F.col("d") + F.col("t")) % 9) / 10).alias("time_affinity"),
    )
    panel = member.select("member_id", "sector", "cell_id", (F.col("n") * 100.0).alias("weight"), "qi", "serviceability")
    names = ("scenario", "movement_mult", "visibility_mult", "share_mult", "concentration")
    scenarios = literal_table(spark, {n: list(x) for n, x in zip(names, zip(*SCENARIOS))}, {n: word if n == "scenario" else real for n in names})
    return Bundle(sites, movement, shares, scores, panel, affinity, scenarios)


#: Briefs of the estimates with the highest claim that each admits, and whether its influence inputs fit.
ASKED = tuple((BRIEFS[n % 3], claim, n != 1) for n, claim in enumerate(("scenario_target_reach", "calibrated_target_reach", "scenario_target_reach", "target_ots", "general_ots", "movement", "activity_potential", "context")))
ACTIVITY = 50.0


def _named(df: DataFrame, briefs: tuple[Brief, ...]) -> DataFrame:
    return df.withColumn("sector", F.element_at(F.array(*[F.lit(b.sector) for b in briefs]), F.col("brief_id") + 1))


def _briefs_sql(briefs: tuple[Brief, ...], claims: list[tuple[int, bool]]) -> str:
    rows = [f"({n}, {SECTORS.index(b.sector)}, '{b.sector}', '{b.objective}', {h}, {i}, {', '.join(f'{float(WEIGHTS[b.objective][k])}::DOUBLE' for k in 'ADCPE')})" for n, (b, (h, i)) in enumerate(zip(briefs, claims))]
    return f"br AS (SELECT * FROM (VALUES {', '.join(rows)}) t(b, s, sector, objective, highest, influence_ok, wa, wd, wc, wp, we))"


_TARGETS_SQL = ", ".join(f"({t}, {SECTORS.index(x[0])}, {t % 3}, {x[3]}::DOUBLE, {x[4]}::DOUBLE)" for t, x in enumerate(TARGETS))
_SCENARIOS_SQL = ", ".join(f"('{n}', {m}::DOUBLE, {v}::DOUBLE, {s}::DOUBLE)" for n, m, v, s, _ in SCENARIOS)


def _ctes(briefs: tuple[Brief, ...] = BRIEFS, claims: list[tuple[int, bool]] | None = None) -> str:
    """Packages of the best eight zones' one or two best sites, or of all sites if they are few, measured member by member."""
    return f"""
{_briefs_sql(briefs, claims or [(5, True)] * len(briefs))},
li AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
site AS (SELECT s_suppkey AS k, s_nationkey AS z, 'site-' || s_suppkey AS id, 'zone-' || lpad(s_nationkey::VARCHAR, 2, '0') AS zone, 2000000 + round(abs(s_acctbal)) * 400 AS rate,
  coalesce(n, 0) * (CASE WHEN s_suppkey % {BUSY} = 0 THEN {BUSY_TIMES} ELSE 1 END) * 10 * 1.18::DOUBLE AS mov, 0.44::DOUBLE + 0.06::DOUBLE * (s_suppkey % 4) AS vis, CASE WHEN s_suppkey % 3 = 0 THEN 0.9::DOUBLE * 0.2::DOUBLE ELSE 1.0::DOUBLE END AS up FROM supplier LEFT JOIN li ON li.k = s_suppkey),
sc AS (SELECT * FROM (VALUES {_SCENARIOS_SQL}) t(scenario, mm, vm, sm)), tg AS (SELECT * FROM (VALUES {_TARGETS_SQL}) t(t, s, c, qi, sv)),
pil AS (SELECT b, k, id, zone, rate, (55 + 5 * ((k + 3 * s) % 8))::DOUBLE AS a, (50 + 5 * ((2 * k + s) % 9))::DOUBLE AS c, (58 + 5 * ((z + s) % 7))::DOUBLE AS p, (52 + 5 * ((k + s) % 8))::DOUBLE AS e, wa, wc, wp, we FROM site, br),
top AS (SELECT *, row_number() OVER (PARTITION BY b, zone ORDER BY score DESC, rate, id) AS place FROM (SELECT *, (a * wa + c * wc + p * wp + e * we) / (wa + wc + wp + we) AS score FROM pil WHERE rate <= 30000000) QUALIFY place <= 2),
zone AS (SELECT b, zone, count(*) AS held FROM top GROUP BY b, zone QUALIFY row_number() OVER (PARTITION BY b ORDER BY avg(score) DESC, zone) <= 8),
v AS (SELECT b, zone, n FROM zone, (SELECT unnest([1, 2]) AS n) WHERE n <= held),
trio AS (SELECT b, row_number() OVER () AS q, [x.zone, y.zone, w.zone] AS zones, [x.n, y.n, w.n] AS ns FROM v x JOIN v y USING (b) JOIN v w USING (b) WHERE x.zone < y.zone AND y.zone < w.zone),
num AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS faces FROM site),
masks AS (SELECT m FROM (SELECT unnest(range(1, (SELECT CASE WHEN max(faces) <= {planner.MAX_EXHAUSTIVE_SITES} THEN 1::BIGINT << max(faces) ELSE 1 END FROM num))) AS m) JOIN num ON (m >> i) & 1 = 1 GROUP BY m HAVING count(*) BETWEEN 3 AND 6 AND count(DISTINCT zone) = 3),
inn AS (SELECT t.b, q, top.k, id, top.zone, rate FROM (SELECT b, q, unnest(zones) AS zone, unnest(ns) AS n FROM trio) t JOIN top ON top.b = t.b AND top.zone = t.zone AND place <= n WHERE (SELECT max(faces) FROM num) > {planner.MAX_EXHAUSTIVE_SITES}
  UNION ALL SELECT b, -m, k, id, zone, rate FROM masks JOIN num ON (m >> i) & 1 = 1, br),
pk AS (SELECT b, q, string_agg(id, '|' ORDER BY id) AS package_id, sum(rate) AS cost, count(*) AS n FROM inn GROUP BY ALL HAVING sum(rate) <= 30000000),
mb AS (SELECT c_nationkey * 5 + list_position({list(SEGMENTS)}, c_mktsegment) - 1 AS j, count(*) * 100.0::DOUBLE AS w FROM customer GROUP BY 1),
used AS (SELECT DISTINCT b, k FROM inn),
ots AS (SELECT scenario, used.b, k, z, t, qi, sv, mov * mm * least(1.0::DOUBLE, vis * vm) * up * ((0.16::DOUBLE + 0.045::DOUBLE * ((z + tg.s + c + k % 2) % 5)) * sm) AS o FROM used JOIN site USING (k) JOIN br USING (b) JOIN tg ON tg.s = br.s, sc),
mem AS (SELECT scenario, b, k, t, j, w, qi, sv, o, (0.55::DOUBLE + ((7 * j + 3 * z + t) % 13)::DOUBLE / 10) * (0.70::DOUBLE + ((5 * j + 3 + t) % 9)::DOUBLE / 10) AS v FROM ots JOIN mb ON j % 3 = t % 3),
rate AS (SELECT *, o / sum(w * v) OVER (PARTITION BY scenario, b, k, t) AS x FROM mem),
fail AS (SELECT scenario, b, k, bool_or(o > 0 AND (x < 1e-6::DOUBLE OR x > 12) OR x * v > 8) AS bad FROM rate GROUP BY ALL),
pr AS (SELECT q, scenario, r.b, t, j, w, qi, sv, sum(28 * x * v) AS lam FROM inn JOIN rate r ON r.b = inn.b AND r.k = inn.k GROUP BY ALL),
r AS (SELECT q, scenario, b, sum(w * (1 - exp(-lam))) AS reach, sum(w * qi * (1 - exp(-lam))) AS im, sum(w * qi) AS iu, sum(w * sv * (1 - exp(-lam))) AS sr FROM pr GROUP BY ALL),
tc AS (SELECT q, scenario, ots.b, sum(28 * o) AS tc FROM inn JOIN ots ON ots.b = inn.b AND ots.k = inn.k GROUP BY ALL),
fb AS (SELECT q, scenario, fail.b, bool_or(bad) AS bad FROM inn JOIN fail ON fail.b = inn.b AND fail.k = inn.k GROUP BY ALL),
d AS (SELECT r.*, tc, objective, NOT bad AND coalesce(tc / nullif(reach, 0) <= 12, true) AS ok FROM r JOIN tc USING (q, scenario, b) JOIN fb USING (q, scenario, b) JOIN br USING (b) JOIN pk USING (q, b)),
g AS (SELECT *, CASE WHEN ok THEN CASE objective WHEN 'broad_reach' THEN reach WHEN 'influential_core' THEN im ELSE sr END END AS delivery FROM d)
"""


_RANKED = """
p AS (SELECT q, b, max(delivery) FILTER (WHERE scenario = 'low') AS lo, max(delivery) FILTER (WHERE scenario = 'base') AS ba, max(delivery) FILTER (WHERE scenario = 'high') AS hi FROM g GROUP BY ALL),
pa AS (SELECT q, inn.b, avg(a) AS a, avg(c) AS c, avg(p) AS p, avg(e) AS e FROM inn JOIN pil ON pil.b = inn.b AND pil.k = inn.k GROUP BY ALL),
cand AS (SELECT br.sector, b, q, package_id, cost, CASE WHEN lo <= ba AND ba <= hi THEN round(ba, 6) END AS delivery, a, c, pa.p, e, wa, wd, wc, wp, we, cost <= 18000000 AS valid FROM pk JOIN p USING (q, b) JOIN pa USING (q, b) JOIN br USING (b)),
dd AS (SELECT *, CASE WHEN delivery IS NOT NULL THEN 100.0::DOUBLE * ((rank() OVER (PARTITION BY b, delivery IS NULL ORDER BY delivery) - 1) + 0.5::DOUBLE * count(*) OVER (PARTITION BY b, delivery)) / count(delivery) OVER (PARTITION BY b) END AS mid FROM cand),
ff AS (SELECT *, round((a * wa + mid * wd + c * wc + dd.p * wp + e * we) / 100, 9) AS fit FROM dd),
rk AS (SELECT *, CASE WHEN fit IS NULL THEN (a + c + ff.p + e) / 4 END AS context_score, row_number() OVER (PARTITION BY b ORDER BY valid DESC, CASE WHEN NOT valid THEN greatest(0, cost - 18000000) END NULLS FIRST, fit DESC NULLS LAST, CASE WHEN fit IS NULL THEN (a + c + ff.p + e) / 4 END DESC NULLS LAST, cost, package_id) AS rank FROM ff)
"""

PLAN_CANDIDATES = f"""
WITH {_ctes()}, {_RANKED}
SELECT sector, package_id, cost, round(delivery, 3) AS delivery, fit, round(context_score, 6) AS context_score, valid, CASE WHEN valid THEN '' ELSE 'BUDGET_EXCEEDED' END AS reasons, rank::INT AS rank FROM rk
"""


def plan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = _named(planner.candidates(supplier_bundle(spark, sf), BRIEFS), BRIEFS)
    return found.select("sector", "package_id", "cost", F.round("delivery", 3).alias("delivery"), "fit", F.round("context_score", 6).alias("context_score"), "valid", F.array_join("reasons", ",").alias("reasons"), "rank")


#: The first brief after its budgets have changed.
CHANGED = replace(BRIEFS[0], budget=22_000_000.0, normalization_budget=26_000_000.0)
PLAN_RECALCULATED = f"WITH {_ctes(BRIEFS[:1])}, {_RANKED} SELECT package_id, cost, round(delivery, 3) AS delivery, fit, valid, rank::INT AS rank FROM rk".replace("30000000", "26000000").replace("18000000", "22000000")


def plan_recalculated(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of a brief whose budgets change, from the measures of the plan before."""
    bundle = supplier_bundle(spark, sf)
    before = planner.recalculate(bundle, BRIEFS[0])
    after = planner.recalculate(bundle, CHANGED, before)
    return after.ranked.select("package_id", "cost", F.round("delivery", 3).alias("delivery"), "fit", "valid", "rank")


PLAN_OPTIONS = f"""
WITH {_ctes()}, {_RANKED}, sc0 AS (SELECT *, coalesce(fit, context_score) AS score FROM rk), b1 AS (SELECT * FROM sc0 WHERE rank = 1),
x AS (SELECT sc0.* FROM sc0 JOIN b1 USING (b) WHERE sc0.q <> b1.q QUALIFY row_number() OVER (PARTITION BY sc0.b ORDER BY sc0.valid DESC, sc0.delivery DESC NULLS LAST, sc0.rank) = 1),
y AS (SELECT sc0.* FROM sc0 JOIN b1 USING (b) JOIN x USING (b) WHERE sc0.q <> b1.q AND sc0.q <> x.q
  QUALIFY row_number() OVER (PARTITION BY sc0.b ORDER BY sc0.score >= b1.score - 5 DESC, sc0.valid DESC, CASE WHEN sc0.score >= b1.score - 5 THEN sc0.cost END NULLS FIRST, sc0.rank) = 1)
SELECT sector, style, package_id, cost, fit, round(delivery, 3) AS delivery FROM (SELECT *, 'best_overall' AS style FROM b1 UNION ALL SELECT *, 'maximum_delivery' FROM x UNION ALL SELECT *, 'budget_smart' FROM y)
"""


def plan_options(spark: SparkSession, sf: str) -> DataFrame:
    found = _named(planner.options(planner.candidates(supplier_bundle(spark, sf), BRIEFS)), BRIEFS)
    return found.select("sector", "style", "package_id", "cost", "fit", F.round("delivery", 3).alias("delivery"))


REACH_PANEL = f"""
WITH {_ctes(BRIEFS[:1])} SELECT package_id, scenario, round(tc, 3) AS target_chances, CASE WHEN ok THEN round(reach, 3) END AS reach, CASE WHEN ok THEN round(im, 3) END AS influence_mass, CASE WHEN ok THEN round(sr, 3) END AS serviceable_reach,
  CASE WHEN ok THEN round(100 * im / iu, 3) END AS influence_capture, CASE WHEN ok THEN round(tc / reach, 6) END AS frequency, NOT ok AS failed FROM d JOIN pk USING (q, b)
"""


def reach_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Every package of the first brief under three scenarios."""
    bundle = supplier_bundle(spark, sf)
    found = planner.measure(bundle, BRIEFS[0], planner.candidate_sets(bundle, BRIEFS[0]))
    return found.select("package_id", "scenario", *[F.round(c, 3).alias(c) for c in ("target_chances", "reach", "influence_mass", "serviceable_reach", "influence_capture")], F.round("frequency", 6).alias("frequency"), F.col("failure").isNotNull().alias("failed"))


REACH_LEAVE_ONE_OUT = f"""
WITH {_ctes(BRIEFS[:1])}, z AS (SELECT DISTINCT q, b, zone AS dropped FROM inn),
lam AS (SELECT z.q, dropped, j, t, w, sum(28 * x * v) AS lam FROM z JOIN inn ON inn.q = z.q AND inn.zone <> dropped JOIN rate r ON r.b = inn.b AND r.k = inn.k AND scenario = 'base' GROUP BY ALL),
part AS (SELECT q, dropped, sum(w * (1 - exp(-lam))) AS reach FROM lam GROUP BY ALL),
pt AS (SELECT z.q, dropped, sum(28 * o) AS tc FROM z JOIN inn ON inn.q = z.q AND inn.zone <> dropped JOIN ots ON ots.k = inn.k AND scenario = 'base' GROUP BY ALL),
pf AS (SELECT z.q, dropped, bool_or(bad) AS bad FROM z JOIN inn ON inn.q = z.q AND inn.zone <> dropped JOIN fail ON fail.k = inn.k AND scenario = 'base' GROUP BY ALL)
SELECT package_id, dropped AS zone_id, round(CASE WHEN bad OR tc / nullif(part.reach, 0) > 12 THEN greatest(0, NULL) ELSE greatest(0, delivery - part.reach) END, 3) AS marginal
FROM part JOIN pt USING (q, dropped) JOIN pf USING (q, dropped) JOIN pk USING (q) JOIN (SELECT q, delivery FROM g WHERE scenario = 'base') f USING (q)
"""


def reach_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    bundle, brief = supplier_bundle(spark, sf), BRIEFS[0]
    return planner.leave_one_zone_out(bundle, brief, planner.candidate_sets(bundle, brief)).select("package_id", "zone_id", F.round("marginal", 3).alias("marginal"))


_CLAIMED = [(planner.delivery.CLAIMS.index(claim), influence) for _, claim, influence in ASKED]
PACKAGE_ESTIMATES = f"""
WITH {_ctes(tuple(b for b, *_ in ASKED), _CLAIMED)},
tr AS (SELECT q, b, sum(28 * mov) AS movement, sum(28 * mov * least(1.0::DOUBLE, vis) * up) AS views FROM inn JOIN site USING (k) JOIN pk USING (q, b) GROUP BY ALL),
w AS (SELECT q, b, bool_and(ok) AS whole, max(reach) FILTER (WHERE scenario = 'base') AS reach, max(tc) FILTER (WHERE scenario = 'base') AS tc, max(delivery) FILTER (WHERE scenario = 'low') AS lo, max(delivery) FILTER (WHERE scenario = 'base') AS ba, max(delivery) FILTER (WHERE scenario = 'high') AS hi FROM g GROUP BY ALL),
e AS (SELECT *, CASE WHEN highest >= 5 AND whole THEN 'scenario_target_reach' WHEN highest >= 4 THEN 'target_ots' WHEN highest = 3 THEN 'general_ots' WHEN highest = 2 THEN 'movement' WHEN highest = 1 THEN 'activity_potential' ELSE 'unavailable' END AS claim FROM w JOIN br USING (b) JOIN tr USING (q, b)),
f AS (SELECT *, CASE WHEN claim <> 'scenario_target_reach' THEN 'UNIQUE_REACH_UNAVAILABLE' WHEN objective = 'influential_core' AND NOT influence_ok THEN 'INFLUENCE_PROFILE_INCOMPATIBLE' WHEN lo IS NULL OR ba IS NULL OR hi IS NULL THEN 'OBJECTIVE_DELIVERY_UNAVAILABLE' WHEN NOT (lo <= ba AND ba <= hi) THEN 'INCOHERENT_OBJECTIVE_RANGE' END AS reason FROM e)
SELECT b AS brief_id, sector, package_id, claim, round(CASE claim WHEN 'scenario_target_reach' THEN reach WHEN 'target_ots' THEN tc WHEN 'general_ots' THEN views WHEN 'movement' THEN movement WHEN 'activity_potential' THEN {ACTIVITY} END, 3) AS claim_value,
  CASE WHEN reason IS NULL THEN round(lo, 3) END AS low, CASE WHEN reason IS NULL THEN round(ba, 3) END AS base, CASE WHEN reason IS NULL THEN round(hi, 3) END AS high, reason FROM f JOIN pk USING (q, b)
"""


def package_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of briefs that admit claims of every height; one has no fitting influence inputs."""
    bundle, briefs = supplier_bundle(spark, sf), tuple(b for b, *_ in ASKED)
    word, flag = pa.string(), pa.bool_()
    n = len(briefs)
    inputs = literal_table(
        spark,
        {"brief_id": list(range(n)), "highest": [c for _, c, _ in ASKED], "reach_ok": [True] * n, "influence_ok": [i for *_, i in ASKED], "serviceability_ok": [True] * n, "activity": [ACTIVITY] * n} | {f"{g}_grade": ["D"] * n for g in ("reach", "influence", "serviceability")},
        {"brief_id": pa.int32(), "highest": word, "reach_ok": flag, "influence_ok": flag, "serviceability_ok": flag, "activity": pa.float64(), "reach_grade": word, "influence_grade": word, "serviceability_grade": word},
    )
    found = _named(planner.estimate(bundle, briefs, planner.candidate_sets(bundle, briefs), inputs), briefs)
    return found.select("brief_id", "sector", "package_id", F.col("claim.kind").alias("claim"), F.round("claim.value", 3).alias("claim_value"), *[F.round(f"delivery.{x}", 3).alias(x) for x in ("low", "base", "high")], "delivery.reason")


ENTRIES = {
    "reach_panel": (reach_panel, REACH_PANEL),
    "plan_candidates": (plan_candidates, PLAN_CANDIDATES),
    "plan_options": (plan_options, PLAN_OPTIONS),
    "plan_recalculated": (plan_recalculated, PLAN_RECALCULATED),
    "package_estimates": (package_estimates, PACKAGE_ESTIMATES),
    "reach_leave_one_out": (reach_leave_one_out, REACH_LEAVE_ONE_OUT),
}
