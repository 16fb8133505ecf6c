"""Package planning: exposure, weighted-panel reach, scoring and options, for all candidate packages of all briefs at once.

Every step takes one brief or several; ``brief_id``, a brief's place among them, is a
key of all frames, so several briefs share the scans, joins and shuffles.

A package's reach needs each panel member's rate under it.  Rates add up over
sites, so they are computed once per site and scenario and summed per package:
the cost is sites x members once, then packages x sites x members additions,
rather than the whole chain for each package.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import dates
from marquee.operators import delivery
from marquee.operators.heads import top_per
from marquee.sources.literal import literal_table

#: Pillar weights by objective.
WEIGHTS = {
    "broad_reach": {"A": 20, "D": 35, "C": 15, "P": 20, "E": 10},
    "influential_core": {"A": 25, "D": 35, "C": 20, "P": 10, "E": 10},
    "near_conversion": {"A": 25, "D": 15, "C": 35, "P": 10, "E": 15},
}
DELIVERY = {"broad_reach": "reach", "influential_core": "influence_mass", "near_conversion": "serviceable_reach"}
MAX_EXHAUSTIVE_SITES = 18
GUARDRAIL = 5.0


@dataclass(frozen=True)
class Brief:
    sector: str
    objective: str
    daypart: str = "pm"
    budget: float = 18_000_000.0
    normalization_budget: float = 30_000_000.0
    flight_start: str = "2026-09-01"
    flight_end: str = "2026-09-28"


@dataclass
class Bundle:
    """Long tables of one inventory; see ``demo_bundle`` for their columns."""

    sites: DataFrame
    movement: DataFrame
    shares: DataFrame
    scores: DataFrame
    panel: DataFrame
    affinity: DataFrame
    scenarios: DataFrame
    min_c: float = 1e-6
    max_c: float = 12.0
    max_rate: float = 8.0
    max_frequency: float = 12.0


#: Fixed values of the demonstration inventory.
ZONES = ("yaba", "ikeja", "vi", "oshodi", "lekki")
SECTORS = ("fmcg", "real_estate", "bank_fintech")
TARGETS = (
    ("fmcg", "student_buyers_18_24", 250_000, 0.20, 0.82),
    ("fmcg", "household_nonstudent_buyers_25_44", 240_000, 0.30, 0.88),
    ("fmcg", "residual_convenience_nonstudent_nonhousehold", 310_000, 0.15, 0.91),
    ("real_estate", "diaspora_intenders", 60_000, 0.45, 0.38),
    ("real_estate", "resident_professional_intenders", 180_000, 0.28, 0.66),
    ("real_estate", "resident_nonprofessional_investors", 90_000, 0.40, 0.48),
    ("bank_fintech", "merchant_owner_users", 140_000, 0.35, 0.94),
    ("bank_fintech", "student_nonmerchant_users", 220_000, 0.18, 0.86),
    ("bank_fintech", "professional_nonmerchant_nonstudent_users", 280_000, 0.22, 0.92),
)
DAYPART_FACTORS = (("am", 1.0), ("midday", 0.78), ("pm", 1.18), ("evening", 0.88))
SCENARIOS = (("low", 0.86, 0.94, 0.95, 1.0), ("base", 1.0, 1.0, 1.0, 1.0), ("high", 1.14, 1.04, 1.05, 1.0))


def demo_bundle(spark: SparkSession) -> Bundle:
    """The synthetic inventory of ten faces in five zones, from its formulas."""
    members = 24
    i = F.col("i")
    site = spark.range(2 * len(ZONES)).select(F.col("id").cast("int").alias("i")).withColumns({"z": F.floor(i / 2).cast("int"), "f": i % 2})
    site = site.withColumn("zone_id", F.element_at(F.array(*[F.lit(z) for z in ZONES]), F.col("z") + 1)).withColumn("site_id", F.concat("zone_id", F.lit("-face-"), F.col("f") + 1))
    dooh = i % 3 == 0
    sites = site.select(
        "site_id", "zone_id", i.alias("site_ord"), F.concat(F.lit("supplier-"), i % 3 + 1).alias("supplier_id"), F.when(dooh, "dooh").otherwise("static").alias("format"), (F.lit(2_800_000.0) + 240_000 * i).alias("rate"),
        (F.lit(0.44) + 0.06 * (i % 4)).alias("visibility"), F.when(dooh, 0.9).otherwise(1.0).alias("uptime"), F.when(dooh, 0.2).otherwise(1.0).alias("share_of_time"), F.lit(True).alias("available"),
        F.lit("2026-01-01").cast("date").alias("available_from"), F.lit("2027-12-31").cast("date").alias("available_to"),
    )
    parts = F.array(*[F.struct(F.lit(d).alias("daypart"), F.lit(x).alias("x")) for d, x in DAYPART_FACTORS])
    movement = site.select("site_id", i, F.inline(parts)).select("site_id", "daypart", ((48_000 + 7_500 * i) * F.col("x")).alias("base_movement"))
    sector_of, cell, universe, qi, service = (list(x) for x in zip(*TARGETS))
    number, real, word = pa.int32(), pa.float64(), pa.string()
    targets = literal_table(
        spark,
        {"t": list(range(9)), "s": [SECTORS.index(x) for x in sector_of], "c": [t % 3 for t in range(9)], "sector": sector_of, "cell_id": cell, "universe": universe, "qi": qi, "serviceability": service},
        {"t": number, "s": number, "c": number, "sector": word, "cell_id": word, "universe": real, "qi": real, "serviceability": real},
    )
    shares = site.select("site_id", "z", "f").join(F.broadcast(targets.select("s", "c", "sector", "cell_id"))).select("site_id", "sector", "cell_id", F.col("c").alias("cell_ord"), (F.lit(0.16) + 0.045 * ((F.col("z") + F.col("s") + F.col("c") + F.col("f")) % 5)).alias("share"))
    sector = F.inline(F.array(*[F.struct(F.lit(n).alias("sector"), F.lit(k).alias("s")) for k, n in enumerate(SECTORS)]))
    s = F.col("s")
    scores = site.select("site_id", "z", i, sector).select(
        "site_id", "sector", (55.0 + 5 * ((i + 3 * s) % 8)).alias("A"), (50.0 + 5 * ((2 * i + s) % 9)).alias("C"), (58.0 + 5 * ((F.col("z") + s) % 7)).alias("P"), (52.0 + 5 * ((9 - i + s) % 8)).alias("E")
    )
    m = F.col("m")
    panel = targets.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    panel = panel.withColumn("member_id", F.concat_ws("-", "cell_id", m.cast("string")))
    zone = F.explode(F.array(*[F.struct(F.lit(n).alias("zone_id"), F.lit(k).alias("z")) for k, n in enumerate(ZONES)]))
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("daypart"), F.lit(k + 1).alias("d")) for k, (n, _) in enumerate(DAYPART_FACTORS)]))
    affinity = panel.select("member_id", "m", "t", zone.alias("z")).withColumn("d", part).select(
        "member_id", "z.zone_id", "d.daypart", (F.lit(0.55) + ((7 * m + 3 * F.col("z.z") + F.col("t")) % 13) / 10).alias("zone_affinity"), (F.lit(0.70) + ((5 * m + F.col("d.d") + F.col("t")) % 9) / 10).alias("time_affinity")
    )
    panel = panel.select("member_id", "sector", "cell_id", (F.col("universe") / members).alias("weight"), "qi", "serviceability")
    names = ("scenario", "movement_mult", "visibility_mult", "share_mult", "concentration")
    scenarios = literal_table(spark, {n: list(x) for n, x in zip(names, zip(*SCENARIOS))}, {n: word if n == "scenario" else real for n in names})
    return Bundle(sites, movement, shares, scores, panel, affinity, scenarios)


def repeated_bundle(bundle: Bundle, n: int) -> Bundle:
    """The inventory with ``n`` faces made by going through its own again and again, at slightly other rates and in new suppliers' hands."""
    spark = bundle.sites.sparkSession
    own = bundle.sites.count()
    copy = spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") % own).cast("int").alias("site_ord"))
    names = bundle.sites.select("site_ord", F.col("site_id").alias("source")).join(copy, "site_ord").select("source", "k", F.concat_ws("-", "source", F.lit("copy"), "k").alias("copy_id"))

    def copied(df: DataFrame, **changed: Column) -> DataFrame:
        out = df.join(F.broadcast(names), F.col("site_id") == F.col("source")).withColumns({"site_id": F.col("copy_id"), **changed})
        return out.drop("source", "copy_id", "k")

    sites = copied(bundle.sites, site_ord=F.col("k"), supplier_id=F.concat(F.lit("benchmark-supplier-"), F.col("k") % 12), rate=F.col("rate") + F.col("k") % 7 * 10_000)
    return replace(bundle, sites=sites, movement=copied(bundle.movement), shares=copied(bundle.shares), scores=copied(bundle.scores))


#: The brief of the published planner timings.
BENCHMARK = Brief("fmcg", "broad_reach", "pm", 100_000_000.0, 150_000_000.0)


def flight_compatible(start: str, end: str) -> Column:
    return F.col("available") & (F.col("available_from") <= F.lit(start).cast("date")) & (F.col("available_to") >= F.lit(end).cast("date"))


def brief_rows(spark: SparkSession, briefs: Brief | tuple[Brief, ...]) -> DataFrame:
    """A row per brief with its pillar weights; request-sized, so it may be broadcast."""
    briefs = (briefs,) if isinstance(briefs, Brief) else briefs
    word, real = pa.string(), pa.float64()
    names = ("sector", "objective", "daypart", "budget", "normalization_budget", "flight_start", "flight_end")
    columns = {"brief_id": list(range(len(briefs)))} | {n: [getattr(x, n) for x in briefs] for n in names} | {f"w_{k}": [float(WEIGHTS[x.objective][k]) for x in briefs] for k in "ADCPE"}
    types = {"brief_id": pa.int32()} | {n: real if "budget" in n else word for n in names} | {f"w_{k}": real for k in "ADCPE"}
    rows = literal_table(spark, columns, types)
    return F.broadcast(rows.withColumns({n: F.col(n).cast("date") for n in ("flight_start", "flight_end")}))


def _checked(value: Column, ok: Column, code: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(code)).cast("double"))


def site_chances(bundle: Bundle, brief: Brief | tuple[Brief, ...]) -> DataFrame:
    """Target chances to see of one block, per brief, scenario, site, cell and part of the day, and the number of such blocks.

    Movement below zero, multipliers not above it, and shares or visibilities outside 0 to 1 are errors.
    """
    rows = brief_rows(bundle.sites.sparkSession, brief)
    flights = rows.select("brief_id", "flight_start", "flight_end", F.col("daypart").alias("d"), dates.flight_days(F.col("flight_start"), F.col("flight_end")).alias("days"))
    blocks = dates.exposure_blocks(flights, "flight_start", "flight_end", "d").groupBy("brief_id", F.col("block_daypart").alias("daypart"), "days").agg(F.count(F.lit(1)).alias("n_blocks"))
    sites = bundle.sites.join(bundle.movement, "site_id").join(F.broadcast(blocks), "daypart").join(F.broadcast(bundle.scenarios))
    movement = _checked(F.col("base_movement") * F.col("movement_mult"), (F.col("base_movement") >= 0) & (F.col("movement_mult") > 0), "INVALID_MOVEMENT_INPUT")
    seen = F.least(F.lit(1.0), F.col("visibility") * F.col("visibility_mult"))
    delivered = F.col("uptime") * F.col("share_of_time")
    general = movement * _checked(seen, seen >= 0, "VISIBILITY_OUTSIDE_0_TO_1") * _checked(delivered, delivered.between(0, 1), "DELIVERY_OUTSIDE_0_TO_1")
    cells = bundle.shares.join(rows.select("brief_id", "sector"), "sector")
    share = F.col("share") * F.col("share_mult")
    return sites.withColumn("general", general).join(cells, ["brief_id", "site_id"]).select(
        "brief_id", "scenario", "concentration", "site_id", "site_ord", "zone_id", "daypart", "n_blocks", "cell_id", "cell_ord", (F.col("general") * _checked(share, share.between(0, 1), "TARGET_SHARE_OUTSIDE_0_TO_1")).alias("chances"), "days"
    )


#: Places of the parts of the day, in which failures are looked for.
_PARTS = {name: place for place, name in enumerate(dates.DAYPARTS)}


def member_rates(bundle: Bundle, brief: Brief | tuple[Brief, ...]) -> tuple[DataFrame, DataFrame]:
    """Per brief, scenario and site: each member's rate over the flight, and (second) its chances and first envelope failure.

    The first failure is that of the first cell, then site, then part of the day, scaling before member rates.
    Chances to see without anyone to see them are an error.
    """
    rows = brief_rows(bundle.sites.sparkSession, brief)
    chances = site_chances(bundle, brief)
    members = bundle.panel.join(rows.select("brief_id", "sector"), "sector").join(bundle.affinity, "member_id")
    pairs = chances.join(members.drop("sector"), ["brief_id", "cell_id", "zone_id", "daypart"])
    value = F.pow(F.col("zone_affinity") * F.col("time_affinity"), F.col("concentration"))
    block = ["brief_id", "scenario", "site_id", "daypart", "cell_id"]
    scaled = pairs.withColumn("v", value).withColumn("__base", F.sum(F.col("weight") * F.col("v")).over(Window.partitionBy(*block)))
    none = (F.col("chances") > 0) & (F.col("__base") <= 0)
    c = F.when(none, F.raise_error(F.lit("ZERO_PANEL_PROPENSITY_DENOMINATOR")).cast("double")).when(F.col("__base") != 0, F.col("chances") / F.col("__base")).otherwise(0.0)
    scaled = scaled.withColumn("c", c).withColumn("rate", F.col("c") * F.col("v"))
    rates = scaled.groupBy("brief_id", "scenario", "site_id", "member_id", "weight", "qi", "serviceability").agg(F.sum(F.col("rate") * F.col("n_blocks")).alias("rate"))
    scaling = (F.col("chances") > 0) & ((F.col("c") < bundle.min_c) | (F.col("c") > bundle.max_c))
    kind = F.when(scaling, "SCALING_OUTSIDE_ENVELOPE").when(F.col("rate") > bundle.max_rate, "MEMBER_RATE_OUTSIDE_ENVELOPE")
    part = F.element_at(F.create_map(*[F.lit(x) for pair in _PARTS.items() for x in pair]), F.col("daypart")).alias("part")
    failure = F.min(F.when(kind.isNotNull(), F.struct("cell_ord", "site_ord", part, F.when(scaling, 0).otherwise(1).alias("k"), kind.alias("code")))).alias("failure")
    each = scaled.groupBy("brief_id", "scenario", "site_id", "site_ord", "daypart", "cell_id", "cell_ord").agg(F.first(F.col("chances") * F.col("n_blocks")).alias("chances"), failure)
    sums = each.groupBy("brief_id", "scenario", "site_id").agg(F.sum("chances").alias("chances"), F.min("failure").alias("failure"))
    return rates, sums


def _keyed(packages: DataFrame) -> DataFrame:
    return packages if "brief_id" in packages.columns else packages.withColumn("brief_id", F.lit(0))


def measure(bundle: Bundle, brief: Brief | tuple[Brief, ...], packages: DataFrame) -> DataFrame:
    """Per package and scenario: target chances, reach, influence, serviceable reach, frequency and failure; ``packages`` has package_id, sites (array) and, for several briefs, brief_id."""
    rates, sums = member_rates(_faces_of(bundle, packages), brief)
    return measured_from(bundle, rates, sums, packages)


def _faces_of(bundle: Bundle, packages: DataFrame) -> Bundle:
    """The bundle with the faces alone that some package has; their number follows from the packages, not from the inventory."""
    chosen = packages.select(F.explode("sites").alias("site_id")).distinct()
    return replace(bundle, sites=bundle.sites.join(chosen, "site_id", "left_semi"))


def measured_from(bundle: Bundle, rates: DataFrame, sums: DataFrame, packages: DataFrame) -> DataFrame:
    """``measure`` from the members' rates and the chances of faces."""
    sites = _keyed(packages).select("brief_id", "package_id", F.explode("sites").alias("site_id"))
    people = sites.join(rates, ["brief_id", "site_id"]).groupBy("brief_id", "package_id", "scenario", "member_id", "weight", "qi", "serviceability").agg(F.sum("rate").alias("rate"))
    p = F.col("weight") * (1 - F.exp(-F.col("rate")))
    key = ["brief_id", "package_id", "scenario"]
    reached = people.groupBy(*key).agg(F.sum(p).alias("reach"), F.sum(p * F.col("qi")).alias("influence_mass"), F.sum(F.col("weight") * F.col("qi")).alias("influence_universe"), F.sum(p * F.col("serviceability")).alias("serviceable_reach"))
    seen = sites.join(sums, ["brief_id", "site_id"]).groupBy(*key).agg(F.sum("chances").alias("target_chances"), F.min("failure").alias("first"))
    out = reached.join(seen, key)
    out = out.withColumn("frequency", F.when(F.col("reach") > 0, F.col("target_chances") / F.col("reach")))
    code = F.coalesce(F.col("first.code"), F.when(F.col("frequency") > bundle.max_frequency, "FREQUENCY_OUTSIDE_ENVELOPE"))
    out = out.withColumn("failure", code)
    ok = F.col("failure").isNull()
    return out.select(
        *key, "target_chances", *[F.when(ok, F.col(c)).alias(c) for c in ("reach", "influence_mass", "serviceable_reach", "frequency")],
        F.when(ok & (F.col("influence_universe") > 0), 100 * F.col("influence_mass") / F.col("influence_universe")).alias("influence_capture"), "failure",
    )


def site_traffic(bundle: Bundle, brief: Brief | tuple[Brief, ...]) -> DataFrame:
    """Per brief and site its movement and views over the flight in the base scenario."""
    rows = brief_rows(bundle.sites.sparkSession, brief)
    flights = rows.select("brief_id", "flight_start", "flight_end", F.col("daypart").alias("d"))
    blocks = dates.exposure_blocks(flights, "flight_start", "flight_end", "d").groupBy("brief_id", F.col("block_daypart").alias("daypart")).agg(F.count(F.lit(1)).alias("n"))
    base = F.broadcast(bundle.scenarios.where("scenario = 'base'"))
    each = bundle.sites.join(bundle.movement, "site_id").join(F.broadcast(blocks), "daypart").join(base)
    movement = F.col("base_movement") * F.col("movement_mult") * F.col("n")
    views = movement * F.least(F.lit(1.0), F.col("visibility") * F.col("visibility_mult")) * F.col("uptime") * F.col("share_of_time")
    return each.groupBy("brief_id", "site_id").agg(F.sum(movement).alias("movement"), F.sum(views).alias("views"))


def estimate(bundle: Bundle, brief: Brief | tuple[Brief, ...], packages: DataFrame, inputs: DataFrame) -> DataFrame:
    """What may be claimed of each package and what it delivers.

    ``inputs`` has a row per brief_id: highest (the ceiling of ``claim``), reach_ok, influence_ok and serviceability_ok
    (``delivery.compatible_inputs``), activity, and evidence grades reach_grade, influence_grade, serviceability_grade.
    Numbers that may not be claimed are null; ``fingerprint`` tells equal estimates, ``comparability_key`` comparable ones.
    """
    asked = brief_rows(bundle.sites.sparkSession, brief)
    keyed = _keyed(packages).select("brief_id", "package_id", "sites")
    c = F.col
    measured = measure(bundle, brief, keyed).join(F.broadcast(inputs), "brief_id")
    shown = delivery.permitted_scenario(c("highest"), c("failure"), c("influence_ok"), c("serviceability_ok"))
    measured = measured.select("brief_id", "package_id", "scenario", *[v.alias(n) for n, v in shown.items()])
    names = ("target_chances", "reach", "influence_mass", "influence_capture", "serviceable_reach", "frequency", "failure")
    at = lambda n: F.array(*[F.max(F.when(c("scenario") == s, c(n))) for s in ("low", "base", "high")]).alias(n)
    wide = measured.groupBy("brief_id", "package_id").agg(*[at(n) for n in names])
    traffic = keyed.select("brief_id", "package_id", F.explode("sites").alias("site_id")).join(site_traffic(bundle, brief), ["brief_id", "site_id"])
    traffic = traffic.groupBy("brief_id", "package_id").agg(F.sum("movement").alias("movement"), F.sum("views").alias("views"))
    rows = wide.join(traffic, ["brief_id", "package_id"]).join(keyed, ["brief_id", "package_id"]).join(F.broadcast(inputs), "brief_id").join(asked.select("brief_id", "sector", "objective", "daypart", "flight_start", "flight_end"), "brief_id")
    claimed = delivery.selected_claim(c("highest"), c("reach"), F.get("target_chances", F.lit(1)), c("views"), c("movement"), c("activity"))
    rows = rows.withColumn("claim", claimed)
    ok = {"reach": c("reach_ok"), "influence": c("influence_ok"), "serviceability": c("serviceability_ok")}
    grades = {n: c(f"{n}_grade") for n in ("reach", "influence", "serviceability")}
    values = {"target_reach": c("reach"), "influence_weighted_reached_mass": c("influence_mass"), "serviceable_target_reach": c("serviceable_reach")}
    basis = {n: c(n).cast("string") for n in ("sector", "objective", "daypart", "flight_start", "flight_end", "highest")}
    key = delivery.comparability_key(basis)
    found = delivery.objective_delivery(c("objective"), ok, c("claim.kind"), grades, values)
    print_ = F.sha2(delivery.comparability_key(basis | {"sites": F.array_join(F.array_sort("sites"), "|"), "values": F.to_json(F.struct(*names), {"ignoreNullFields": "false"})}), 256)
    return rows.select("brief_id", "package_id", "claim", found.alias("delivery"), *names, key.alias("comparability_key"), print_.alias("fingerprint"))


def candidate_sets(bundle: Bundle, brief: Brief | tuple[Brief, ...]) -> DataFrame:
    """brief_id, package_id and sites of all packages of three to six sites in exactly three zones within the normalisation budget.

    Small inventories are enumerated; large ones give each of the best eight zones' one or two best sites.
    """
    spark = bundle.sites.sparkSession
    briefs = (brief,) if isinstance(brief, Brief) else brief
    rows = bundle.sites.orderBy("site_ord").select("site_id", "zone_id", "rate").limit(MAX_EXHAUSTIVE_SITES + 1).collect()
    if len(rows) <= MAX_EXHAUSTIVE_SITES:
        found = [
            (b, "|".join(sorted(s.site_id for s in chosen)), [s.site_id for s in chosen])
            for n in range(3, 7)
            for chosen in combinations(rows, n)
            if len({s.zone_id for s in chosen}) == 3
            for b, each in enumerate(briefs)
            if sum(s.rate for s in chosen) <= each.normalization_budget
        ]
        numbers, ids, sites = ([x[k] for x in found] for k in (0, 1, 2))
        return literal_table(spark, {"brief_id": numbers, "package_id": ids, "sites": sites}, {"brief_id": pa.int32(), "package_id": pa.string(), "sites": pa.list_(pa.string())})
    asked = brief_rows(spark, briefs)
    cheap = sum((F.col(k) * F.col(f"w_{k}") for k in "ACPE"), F.lit(0.0)) / sum((F.col(f"w_{k}") for k in "ACPE"), F.lit(0.0))
    sites = bundle.sites.join(bundle.scores, "site_id").join(asked, "sector").where(F.col("rate") <= F.col("normalization_budget")).select("brief_id", "site_id", "zone_id", "rate", cheap.alias("score"))
    top = top_per(sites, ["brief_id", "zone_id"], [F.desc("score"), F.col("rate"), F.col("site_id")], 2)
    zones = top.groupBy("brief_id", "zone_id").agg(F.avg("score").alias("zone_score"), F.array_sort(F.collect_list(F.struct("rank", "site_id", "rate", "score"))).alias("a"))
    zones = top_per(zones, ["brief_id"], [F.desc("zone_score"), F.col("zone_id")], 8)
    v = zones.select("brief_id", "zone_id", "a", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("n")).select("brief_id", "zone_id", F.slice("a", 1, F.col("n")).alias("a"))
    x, y, z = (v.select("brief_id", F.col("zone_id").alias(f"z{k}"), F.col("a").alias(f"a{k}")) for k in range(3))
    # At most sixteen rows a side and brief.
    joined = x.join(y, "brief_id").where("z0 < z1").join(z, "brief_id").where("z1 < z2").select("brief_id", F.concat("a0", "a1", "a2").alias("a"))
    total = lambda f: F.aggregate("a", F.lit(0.0), lambda acc, e: acc + e[f])
    sized = joined.select("brief_id", F.transform("a", lambda e: e["site_id"]).alias("sites"), total("rate").alias("cost"), (total("score") / F.size("a")).alias("score"))
    sized = sized.join(asked.select("brief_id", "normalization_budget"), "brief_id").where(F.col("cost") <= F.col("normalization_budget"))
    named = sized.withColumn("package_id", F.array_join(F.array_sort("sites"), "|"))
    return top_per(named, ["brief_id"], [F.desc("score"), F.col("cost"), F.col("package_id")], 512).select("brief_id", "package_id", "sites")


def candidates(bundle: Bundle, brief: Brief | tuple[Brief, ...], extra: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """All candidate packages with delivery, pillars, fit, validity and rank.

    Packages that cannot fly are left out unless none can.  ``extra`` packages are
    measured against the same cohort without being part of it.  ``measured`` holds the
    measures of all of them where they are known.
    """
    asked = brief_rows(bundle.sites.sparkSession, brief)
    sets = candidate_sets(bundle, brief).withColumn("extra", F.lit(False))
    can_fly = F.col("available") & (F.col("available_from") <= F.col("flight_start")) & (F.col("available_to") >= F.col("flight_end"))
    facts = bundle.sites.join(bundle.scores, "site_id").join(asked.select("brief_id", "sector", "flight_start", "flight_end"), "sector").withColumn("flies", can_fly).drop("sector", "flight_start", "flight_end")
    if extra is not None:
        sets = sets.unionByName(_keyed(extra).select("brief_id", "package_id", "sites", F.lit(True).alias("extra")))
    each = sets.select("brief_id", "package_id", "extra", F.explode("sites").alias("site_id")).join(facts, ["brief_id", "site_id"])
    own = ["brief_id", "package_id", "extra"]
    summed = each.groupBy(*own).agg(
        F.sum("rate").alias("cost"), F.count(F.lit(1)).alias("n_sites"), F.countDistinct("zone_id").alias("n_zones"), *[F.avg(k).alias(k) for k in "ACPE"], F.bool_and("flies").alias("flies"), F.bool_and("available").alias("available")
    )
    of_brief = Window.partitionBy("brief_id")
    summed = summed.withColumn("__any", F.max(F.col("flies") & ~F.col("extra")).over(of_brief)).where(F.col("flies") | F.col("extra") | ~F.col("__any")).drop("__any")
    # An extra package may be one of the candidates as well; it is measured once.
    if measured is None:
        measured = measure(bundle, brief, sets.select("brief_id", "package_id", "sites").dropDuplicates(["brief_id", "package_id"]) if extra is not None else sets)
    goals = asked.select("brief_id", "objective")
    metric = F.when(F.col("objective") == "broad_reach", F.col(DELIVERY["broad_reach"]))
    for objective in ("influential_core", "near_conversion"):
        metric = metric.when(F.col("objective") == objective, F.col(DELIVERY[objective]))
    measured = measured.join(goals, "brief_id").withColumn("delivery", metric)
    range_ = measured.groupBy("brief_id", "package_id").agg(*[F.max(F.when(F.col("scenario") == s, F.col("delivery"))).alias(f"delivery_{s}") for s in ("low", "base", "high")], F.min("failure").alias("failure"))
    coherent = (F.col("delivery_low") <= F.col("delivery_base")) & (F.col("delivery_base") <= F.col("delivery_high"))
    # Equal deliveries must compare equal whatever order their sums ran in.
    joined = summed.join(range_, ["brief_id", "package_id"]).withColumn("delivery", F.when(coherent, F.round("delivery_base", 6)))
    cohort = ~F.col("extra") & F.col("delivery").isNotNull()
    w = of_brief.orderBy("delivery").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("brief_id", "delivery")
    upto, equal, n = F.count_if(cohort).over(w), F.count_if(cohort).over(same), F.count_if(cohort).over(of_brief)
    scored = joined.withColumn("D", F.when(F.col("delivery").isNotNull() & (n > 0), 100.0 * (upto - 0.5 * equal) / n))
    scored = scored.join(asked.select("brief_id", "budget", "normalization_budget", *[f"w_{k}" for k in "ADCPE"]), "brief_id")
    scored = scored.withColumn("fit", F.round(sum((F.col(k) * F.col(f"w_{k}") for k in "ADCPE"), F.lit(0.0)) / 100, 9))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("n_sites").between(3, 6), "SITE_COUNT_OUTSIDE_3_TO_6"), F.when(F.col("n_zones") != 3, "EXACTLY_THREE_ZONES_REQUIRED"), F.when(F.col("cost") > F.col("budget"), "BUDGET_EXCEEDED"),
            F.when(F.col("cost") > F.col("normalization_budget"), "NORMALIZATION_ENVELOPE_EXCEEDED"), F.when(~F.col("available"), "SITE_UNAVAILABLE"), F.when(~F.col("flies"), "SITE_UNAVAILABLE_FOR_FLIGHT"),
        )
    )
    context = F.when(F.col("fit").isNull(), (F.col("A") + F.col("C") + F.col("P") + F.col("E")) / 4)
    scored = scored.withColumns({"reasons": reasons, "context_score": context}).withColumn("valid", F.size("reasons") == 0)
    order = [
        F.desc("valid"), F.when(~F.col("valid"), F.size("reasons")), F.when(~F.col("valid"), F.greatest(F.lit(0.0), F.col("cost") - F.col("budget"))), F.desc_nulls_last("fit"), F.desc_nulls_last("context_score"), F.col("cost"), F.col("package_id"),
    ]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("brief_id", "extra").orderBy(*order)))
    return ranked.drop("budget", "normalization_budget", *[f"w_{k}" for k in "ADCPE"])


@dataclass(frozen=True)
class Basis:
    """What a plan was made from, kept for the next one: a brief, its faces' rates and chances, and its packages' measures.

    ``fresh`` are the packages that were measured when it was made.
    """

    brief: Brief
    rates: DataFrame
    sums: DataFrame
    measured: DataFrame
    fresh: DataFrame
    ranked: DataFrame

    def release(self) -> None:
        for df in (self.rates, self.sums, self.measured, self.fresh):
            df.unpersist()


def selected_package(spark: SparkSession, sites: list[str]) -> DataFrame:
    return literal_table(spark, {"brief_id": [0], "package_id": ["|".join(sorted(sites))], "sites": [list(sites)]}, {"brief_id": pa.int32(), "package_id": pa.string(), "sites": pa.list_(pa.string())})


def recalculate(bundle: Bundle, brief: Brief, earlier: Basis | None = None, selected: list[str] | None = None) -> Basis:
    """The plan of a changed brief, or with packages that the user selected, from what an earlier plan of the bundle has measured.

    Rates depend on the sector, the part of the day and the flight alone: if one of these differs all is measured anew.
    Else only faces without rates and packages without measures are; a change of budget or of pillars needs none.  The
    selected package is ranked as an ``extra`` one.  Kept frames are persisted; ``release`` frees them.
    """
    spark = bundle.sites.sparkSession
    extra = selected_package(spark, selected) if selected else None
    sets = candidate_sets(bundle, brief)
    if extra is not None:
        sets = sets.unionByName(extra).dropDuplicates(["brief_id", "package_id"])
    sets = sets.persist()
    basis = ("sector", "daypart", "flight_start", "flight_end")
    same = earlier is not None and all(getattr(earlier.brief, n) == getattr(brief, n) for n in basis)
    fresh = (sets.join(earlier.measured.select("brief_id", "package_id").distinct(), ["brief_id", "package_id"], "left_anti") if same else sets).persist()
    faces = _faces_of(bundle, fresh)
    if same:
        faces = replace(faces, sites=faces.sites.join(earlier.sums.select("site_id").distinct(), "site_id", "left_anti"))
    new_rates, new_sums = member_rates(faces, brief)
    rates, sums = ((earlier.rates.unionByName(new_rates), earlier.sums.unionByName(new_sums)) if same else (new_rates, new_sums))
    rates, sums = rates.persist(), sums.persist()
    added = measured_from(bundle, rates, sums, fresh)
    measured = (earlier.measured.unionByName(added) if same else added).persist()
    ranked = candidates(bundle, brief, extra, measured.join(sets.select("brief_id", "package_id"), ["brief_id", "package_id"], "left_semi"))
    return Basis(brief, rates, sums, measured, fresh, ranked)


def options(ranked: DataFrame) -> DataFrame:
    """Per brief best overall, maximum delivery and budget smart, none twice; invalid packages only where no valid one is left.

    Each pick is the first of an ordered window from which the earlier picks are
    moved to the end, so the candidates are computed once.
    """
    rows = ranked.where(~F.col("extra")).select("brief_id", "package_id", "cost", "fit", "delivery", "valid", "rank", F.coalesce("fit", "context_score").alias("score"))

    def first(column: str, *order: Column) -> Column:
        return F.first(column).over(Window.partitionBy("brief_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    rows = rows.withColumns({"best": first("package_id", F.col("rank")), "top": first("score", F.col("rank"))})
    taken = F.col("package_id") == F.col("best")
    rows = rows.withColumn("maximum", first("package_id", taken, F.desc("valid"), F.desc_nulls_last("delivery"), F.col("rank")))
    taken = taken | (F.col("package_id") == F.col("maximum"))
    near = F.col("score") >= F.col("top") - GUARDRAIL
    rows = rows.withColumn("budget", first("package_id", taken, F.desc(near), F.desc("valid"), F.when(near, F.col("cost")), F.col("rank")))
    style = F.when(F.col("package_id") == F.col("best"), "best_overall").when(F.col("package_id") == F.col("maximum"), "maximum_delivery").when(F.col("package_id") == F.col("budget"), "budget_smart")
    return rows.select("brief_id", style.alias("style"), "package_id", "cost", "fit", "delivery").where("style IS NOT NULL")


def leave_one_zone_out(bundle: Bundle, brief: Brief, packages: DataFrame) -> DataFrame:
    """What each zone adds to a package's delivery in the base scenario: full less without it, never below zero."""
    zones = bundle.sites.select("site_id", "zone_id")
    each = packages.select("package_id", F.explode("sites").alias("site_id")).join(zones, "site_id")
    without = each.select("package_id", F.col("zone_id").alias("dropped")).distinct().join(each, "package_id").where(F.col("zone_id") != F.col("dropped"))
    reduced = without.groupBy("package_id", "dropped").agg(F.collect_list("site_id").alias("sites")).withColumn("part_id", F.concat_ws("#", "package_id", "dropped"))
    both = packages.select("package_id", "sites").union(reduced.select(F.col("part_id").alias("package_id"), "sites"))
    found = measure(bundle, brief, both).where("scenario = 'base'").select(F.col("package_id").alias("id"), F.col(DELIVERY[brief.objective]).alias("delivery"))
    full, part = found.select(F.col("id").alias("package_id"), F.col("delivery").alias("full")), found.select(F.col("id").alias("part_id"), F.col("delivery").alias("reduced"))
    return reduced.join(full, "package_id").join(part, "part_id").select("package_id", F.col("dropped").alias("zone_id"), F.greatest(F.lit(0.0), F.col("full") - F.col("reduced")).alias("marginal"))


def request_lines(bundle: Bundle, brief: Brief, package_id: Column | str, packages: DataFrame) -> DataFrame:
    """One row per supplier of a package with its own lines only."""
    each = packages.where(F.col("package_id") == package_id).select(F.explode("sites").alias("site_id")).join(bundle.sites, "site_id")
    line = F.struct("site_id", "zone_id", "format", "rate")
    return each.groupBy("supplier_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("rate").alias("total")).select("supplier_id", "lines", "total", F.lit(brief.flight_start).alias("flight_start"), F.lit(brief.flight_end).alias("flight_end"), F.lit("DRAFT — NOT YET SENT").alias("stamp"))


BRIEFS = (Brief("fmcg", "broad_reach"), Brief("real_estate", "influential_core"), Brief("bank_fintech", "near_conversion"))


def claim(available: dict[str, Column]) -> Column:
    """The highest claim the inputs permit, with its reason: an ordered list of ceilings, of which the first that applies holds.

    ``available`` has boolean columns precise, low_precision, failed, calibrated, activity, movement, geometry, converted, target, and strings overlap, schedule; qi.
    """
    a = available
    result = lambda high, reason, cap, qi=False: F.struct(F.lit(high).alias("claim") if isinstance(high, str) else high.alias("claim"), F.lit(reason).cast("string").alias("reason"), (F.lit(cap) if isinstance(cap, str) else cap).alias("cap"), (F.lit(False) if qi is False else qi).alias("influence"))
    low = F.when(a["activity"], "activity_potential").otherwise("context")
    by_schedule = F.when(a["schedule"] == "assumed", "D").otherwise("C")
    assumed = (a["overlap"] == "assumed") | (a["schedule"] == "assumed")
    return (
        F.when(a["unknown"], result("context", "UNKNOWN_ADDRESS", "D"))
        .when(a["low_precision"], result("context", "LOW_PRECISION_GEOCODE", "D"))
        .when(a["failed"], result("context", "ENRICHMENT_UNAVAILABLE", "D"))
        .when(~a["calibrated"], result(low, "CALIBRATION_OUTSIDE", "D"))
        .when(~a["movement"], result(low, "MOVEMENT_UNAVAILABLE", "D"))
        .when(~a["converted"], result("movement", "OCCUPANCY_CONVERSION_UNAVAILABLE", "D"))
        .when(~a["geometry"] | (a["schedule"] == "missing"), result("movement", "EXPOSURE_GEOMETRY_OR_SCHEDULE_UNAVAILABLE", "D"))
        .when(~a["target"], result("general_ots", "TARGET_BASIS_UNAVAILABLE", by_schedule))
        .when(a["overlap"] == "missing", result("target_ots", "OVERLAP_MODEL_UNAVAILABLE", by_schedule))
        .otherwise(F.struct(F.when(assumed, "scenario_target_reach").otherwise("calibrated_target_reach").alias("claim"), F.when(~a["qi"], "QI_UNAVAILABLE").alias("reason"), F.when(assumed, "D").otherwise("C").alias("cap"), a["qi"].alias("influence")))
    )


def claim_ladder(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = {n: k % m != 0 for n, m in (("calibrated", 11), ("movement", 7), ("converted", 13), ("geometry", 5), ("target", 4), ("qi", 3), ("activity", 2))}
    flags |= {n: k % m == 0 for n, m in (("unknown", 29), ("low_precision", 23), ("failed", 19))}
    flags |= {"overlap": F.element_at(F.array(F.lit("assumed"), F.lit("qualified"), F.lit("missing")), (k % 3 + 1).cast("int")), "schedule": F.element_at(F.array(F.lit("assumed"), F.lit("compatible"), F.lit("compatible"), F.lit("missing")), (k % 4 + 1).cast("int"))}
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", claim(flags).alias("c"))
    return rows.select("c_custkey", "c.claim", "c.reason", "c.cap", "c.influence")


CLAIM_LADDER = """
WITH f AS (SELECT c_custkey AS k, ['assumed', 'qualified', 'missing'][c_custkey % 3 + 1] AS o, ['assumed', 'compatible', 'compatible', 'missing'][c_custkey % 4 + 1] AS s FROM customer),
r AS (SELECT *, CASE WHEN k % 29 = 0 THEN 1 WHEN k % 23 = 0 THEN 2 WHEN k % 19 = 0 THEN 3 WHEN k % 11 = 0 THEN 4 WHEN k % 7 = 0 THEN 5 WHEN k % 13 = 0 THEN 6 WHEN k % 5 = 0 OR s = 'missing' THEN 7 WHEN k % 4 = 0 THEN 8 WHEN o = 'missing' THEN 9 ELSE 10 END AS rung FROM f)
SELECT k AS c_custkey,
  CASE WHEN rung <= 3 THEN 'context' WHEN rung <= 5 THEN CASE WHEN k % 2 <> 0 THEN 'activity_potential' ELSE 'context' END WHEN rung <= 7 THEN 'movement' WHEN rung = 8 THEN 'general_ots' WHEN rung = 9 THEN 'target_ots' WHEN o = 'assumed' OR s = 'assumed' THEN 'scenario_target_reach' ELSE 'calibrated_target_reach' END AS claim,
  CASE WHEN rung = 10 THEN CASE WHEN k % 3 = 0 THEN 'QI_UNAVAILABLE' END ELSE ['UNKNOWN_ADDRESS', 'LOW_PRECISION_GEOCODE', 'ENRICHMENT_UNAVAILABLE', 'CALIBRATION_OUTSIDE', 'MOVEMENT_UNAVAILABLE', 'OCCUPANCY_CONVERSION_UNAVAILABLE', 'EXPOSURE_GEOMETRY_OR_SCHEDULE_UNAVAILABLE', 'TARGET_BASIS_UNAVAILABLE', 'OVERLAP_MODEL_UNAVAILABLE'][rung] END AS reason,
  CASE WHEN rung <= 7 THEN 'D' WHEN rung <= 9 THEN CASE WHEN s = 'assumed' THEN 'D' ELSE 'C' END WHEN o = 'assumed' OR s = 'assumed' THEN 'D' ELSE 'C' END AS cap, rung = 10 AND k % 3 <> 0 AS influence FROM r
"""


ENTRIES = {
    "claim_ladder": (claim_ladder, CLAIM_LADDER),
}
