"""Rules that rows, bundles and requests must keep, as column expressions and frames of what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators import ranks

#: Rows of a cohort below which no activity potential is stated, and slack of area sums.
LEAST_COHORT = 30
AREA_SLACK = 1.00000001


def coverage_status(places: Column, roads: Column) -> Column:
    return F.when(places & roads, "full").when(places, "places_only").when(roads, "roads_only").otherwise("uncovered")


def population_rules(c: dict[str, Column]) -> dict[str, Column]:
    """Accounting of cells of a population row; each rule by name."""
    return {
        "cell_accounting": c["candidates"] == c["valid"] + c["nodata"], "reachable": c["reachable"] <= c["valid"], "friction_unavailable": c["unavailable"] <= c["valid"],
        "threshold_frontier": c["max_minutes"] <= c["threshold"] + 1e-9,
    }


def settlement_rules(c: dict[str, Column]) -> dict[str, Column]:
    """Areas, counts and the nearest distance of a settlement row must agree."""
    none = (c["settled"] == 0) & (c["extents"] == 0) & (c["components"] == 0) & (c["largest"] == 0) & c["largest_share"].isNull()
    some = (c["settled"] > 0) & (c["extents"] > 0) & (c["components"] > 0) & (c["largest"] > 0) & c["largest_share"].isNotNull()
    return {
        "settled_within_buffer": c["settled"] <= c["buffer"] * AREA_SLACK, "largest_within_settled": c["largest"] <= c["settled"] * AREA_SLACK, "component_alignment": none | some,
        "nearest_alignment": F.when(c["inside"], c["nearest"] == 0).otherwise(c["nearest"].isNotNull() & (c["nearest"] >= 0)),
    }


def rate_rules(c: dict[str, Column]) -> dict[str, Column]:
    return {"rate_accounting": c["rated"] + c["missing"] == c["rows"], "period_month": (c["grain"] == "quarter") == c["month"].isNull()}


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, in order; a rule that is null is kept, as a database would have it."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()]))


def activity_potential(values: DataFrame, cohort: DataFrame, keys: list[str], ranges: int = 64) -> DataFrame:
    """Values (keys, value) with their mid-rank percentage among a fixed cohort (value); null if the cohort is too small."""
    ranked = ranks.mid_ranks(cohort, values, ranges)
    potential = F.when(F.col("total") >= LEAST_COHORT, 100.0 * (F.col("below") + 0.5 * F.col("same")) / F.col("total")).alias("potential")
    return values.select(*keys, "value").join(ranked, "value", "left").select(*keys, "value", potential)


def claim_failure(kind: Column, low: Column, base: Column, high: Column, universe: Column, state: Column, evidence: Column, quantile: Column) -> Column:
    """Why a claim is refused, or null: its range must be ordered and within its universe or a hundred per cent, and its state fit its kind."""
    share = kind.isin("influence_capture", "influence_weighted_coverage")
    return (
        F.when((low < 0) | ~((low <= base) & (base <= high)), "RANGE_ORDER_INVALID")
        .when(kind.isin("scenario_target_reach", "calibrated_target_reach") & ((universe <= 0) | (high > universe)), "REACH_EXCEEDS_UNIVERSE")
        .when(share & (high > 100), "PERCENTAGE_EXCEEDS_100")
        .when(share & ~quantile & ((state != "assumed") | (evidence != "D")), "SCENARIO_INFLUENCE_NOT_ASSUMED_D")
        .when(share & quantile & (state != "modelled"), "QUANTILE_INFLUENCE_NOT_MODELLED")
    )


def request_failure(confirmed: Column, start: Column, end: Column, deadline: Column, name: Column, email: Column) -> Column:
    """The first reason why a request may not go out, or null."""
    return (
        F.when(F.length(F.trim(name)) < 2, "BUYER_NAME_REQUIRED")
        .when(~F.trim(email).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "BUYER_EMAIL_INVALID")
        .when(~confirmed, "FLIGHT_DATES_NOT_CONFIRMED")
        .when(start > end, "FLIGHT_DATE_ORDER_INVALID")
        .when(deadline >= start, "RESPONSE_DEADLINE_TOO_LATE")
    )


def bundle_failures(bundle, targets: DataFrame) -> DataFrame:
    """All that is wrong with a planning bundle: rows of code and subject; ``targets`` has sector, cell_id, universe.

    Scenarios must be low, base and high with rising multipliers and one concentration; panel weights add up to each
    universe; members and shares belong to the sector's cells; shares stay probabilities under every scenario.
    """
    subject = lambda code, df, *cols: df.select(F.lit(code).alias("code"), F.concat_ws("/", *cols).alias("subject"))
    s = bundle.scenarios
    names = s.agg(F.array_sort(F.collect_list("scenario")).alias("n"), *[F.max(F.when(F.col("scenario") == x, F.struct("movement_mult", "visibility_mult", "share_mult", "concentration"))).alias(x) for x in ("low", "base", "high")])
    rising = lambda m: (F.col(f"low.{m}") <= F.col(f"base.{m}")) & (F.col(f"base.{m}") <= F.col(f"high.{m}"))
    steady = (F.col("low.concentration") == F.col("base.concentration")) & (F.col("base.concentration") == F.col("high.concentration"))
    found = subject("SCENARIOS_NOT_LOW_BASE_HIGH", names.where(F.col("n") != F.array(*[F.lit(x) for x in ("base", "high", "low")])), F.array_join("n", ","))
    for m in ("movement_mult", "visibility_mult", "share_mult"):
        found = found.union(subject("SCENARIO_NOT_MONOTONE", names.where(~rising(m)), F.lit(m)))
    found = found.union(subject("CONCENTRATION_NOT_FIXED", names.where(~steady), F.lit("concentration")))
    for code, df, keys in (("DUPLICATE_TARGET", targets, ["sector", "cell_id"]), ("DUPLICATE_MEMBER", bundle.panel, ["member_id"]), ("DUPLICATE_SITE", bundle.sites, ["site_id"])):
        found = found.union(subject(code, df.groupBy(*keys).count().where("count > 1"), *keys))
    weights = bundle.panel.groupBy("sector", "cell_id").agg(F.sum("weight").alias("w"))
    off = targets.join(weights, ["sector", "cell_id"], "left").where(F.abs(F.coalesce("w", F.lit(0.0)) - F.col("universe")) > 1e-6)
    found = found.union(subject("PANEL_WEIGHT_NOT_UNIVERSE", off, "sector", "cell_id"))
    found = found.union(subject("MEMBER_OUTSIDE_TARGETS", bundle.panel.join(targets, ["sector", "cell_id"], "left_anti"), "member_id"))
    cells = bundle.sites.select("site_id").join(targets.select("sector", "cell_id"))
    shares = bundle.shares.select("site_id", "sector", "cell_id")
    found = found.union(subject("SHARE_PARTITION_MISMATCH", cells.join(shares, ["site_id", "sector", "cell_id"], "left_anti").union(shares.join(targets, ["sector", "cell_id"], "left_anti").select("site_id", "sector", "cell_id")), "site_id", "sector", "cell_id"))
    most = s.agg(F.max("share_mult").alias("m"))
    sums = bundle.shares.groupBy("site_id", "sector").agg(F.sum("share").alias("t"))
    return found.union(subject("SHARES_EXCEED_ONE", sums.join(F.broadcast(most)).where((F.col("t") > 1) | (F.col("t") * F.col("m") > 1)), "site_id", "sector"))


def snapshot_guards(releases: tuple[str, str], boxes: tuple[tuple, tuple], coordinates: int, basis_rows: int, manifest_rows: int, resolved_at: str | None, sourced_at: str | None) -> list[str]:
    """Codes that forbid a derivation before it starts: releases and boxes must agree, something must be eligible, the basis be one row and not stale."""
    found = [
        ("RELEASE_MISMATCH", releases[0] != releases[1]), ("BOUNDS_MISMATCH", boxes[0] != boxes[1]), ("NO_ELIGIBLE_COORDINATES", coordinates < 1), ("BASIS_ROW_REQUIRED", basis_rows != 1), ("EMPTY_MANIFEST", manifest_rows < 1),
        ("RESOLUTION_OLDER_THAN_SOURCE", resolved_at is None or sourced_at is None or resolved_at < sourced_at),
    ]
    return [code for code, wrong in found if wrong]


def eligible_sources(snapshots: DataFrame, role: str, version: str, signature: str | None = None) -> DataFrame:
    """Snapshots (source_id, role, version, license_id, commercial_use, grid_signature) that a derivation may read, with the reason for the others."""
    grid = F.lit(False) if signature is None else ~F.coalesce(F.col("grid_signature") == signature, F.lit(False))
    reason = F.when(F.col("role") != role, "ROLE").when(F.col("version") != version, "VERSION").when(F.coalesce(F.length(F.trim("license_id")), F.lit(0)) == 0, "LICENSE").when(F.col("commercial_use") != "permitted", "RIGHTS").when(grid, "GRID_SIGNATURE")
    return snapshots.select("source_id", reason.alias("reason"))


def without_lineage(reduced: DataFrame, lineage: DataFrame) -> DataFrame:
    """Reduced artifacts that no parent is recorded for."""
    return reduced.join(lineage.select(F.col("child_id").alias("artifact_id")), "artifact_id", "left_anti")


def changed_evidence(old: DataFrame, new: DataFrame, key: str, free: tuple[str, ...], references: list[DataFrame]) -> DataFrame:
    """Keys of referenced rows of which a column other than ``free`` changes."""
    fixed = [c for c in old.columns if c != key and c not in free]
    used = references[0].select(key)
    for other in references[1:]:
        used = used.union(other.select(key))
    both = old.join(new.select(key, F.struct(*fixed).alias("__new")), key)
    return both.where(~F.struct(*fixed).eqNullSafe(F.col("__new"))).join(used, key, "left_semi").select(key)
