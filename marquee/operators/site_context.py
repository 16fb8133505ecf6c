"""One row per confirmed site with its three context families, and comparison of pairs of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.stats import relative_direction
from marquee.operators.heads import first_per

#: Metrics by family, and whether the lower value is the better one (a distance).
CONTRASTS = (
    ("vector", "destination_presence", "place_count", False), ("vector", "destination_diversity", "taxonomy_entropy", False), ("vector", "nearest_major_road_distance_m", "nearest_major_road_m", True),
    ("vector", "major_road_density_km_per_km2", "major_road_density", False), ("raster", "resident_population", "population", False), ("raster", "accessible_population", "accessible_population", False),
    ("settlement", "settled_area_share", "settled_area_share", False), ("settlement", "settlement_core_depth", "core_depth_m", False), ("settlement", "settlement_component_density", "component_density", False),
)
FAMILIES = ("vector", "raster", "settlement")


def accessible_heads(rows: DataFrame) -> DataFrame:
    """The latest row per site, assertion, mode and threshold; each row stands for itself, so thresholds may come from several snapshots."""
    return first_per(rows, ["site_id", "assertion_id", "access_mode", "threshold"], [F.desc("created_at"), F.desc("snapshot_id")])


def read_model(sites: DataFrame, context: DataFrame) -> DataFrame:
    """One row per confirmed site and assertion: an array of context rows per family, or the reason why a family is missing.

    ``sites``: site_id, assertion_id, eligible.  ``context``: site_id, assertion_id, family, basis (its key within the family),
    covered, and metric columns of CONTRASTS.  Families are independent: one may be missing while others are there.
    """
    metrics = list(dict.fromkeys(c for _, _, c, _ in CONTRASTS))
    row = F.struct("basis", "covered", *metrics)
    pivoted = context.groupBy("site_id", "assertion_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("family") == f, row))).alias(f) for f in FAMILIES])
    joined = sites.join(pivoted, ["site_id", "assertion_id"], "left")
    some = {f: F.coalesce(F.size(f), F.lit(0)) > 0 for f in FAMILIES}
    reason = lambda f: F.when(~F.col("eligible"), "coordinate_not_currently_eligible").when(~some[f], "not_derived")
    return joined.select("site_id", "assertion_id", "eligible", *[F.when(some[f], F.col(f)).alias(f) for f in FAMILIES], *[reason(f).alias(f"{f}_missing") for f in FAMILIES])


def contrasts(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """Per pair (left_id, right_id of eligible sites), family, metric and basis: both values and the direction.

    Only rows covered on both sides with the same key compare; a value missing on either side gives no contrast.
    """
    metrics = [F.struct(F.lit(f).alias("f"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(low).alias("lower")) for f, m, c, low in CONTRASTS]
    own = F.filter(F.array(*metrics), lambda x: (x["f"] == F.col("family")) & x["value"].isNotNull())
    values = context.where("covered").select("site_id", "family", "basis", F.inline(own)).drop("f")
    side = lambda s: values.select(F.col("site_id").alias(f"{s}_id"), "family", "basis", "metric", "lower", F.col("value").alias(f"{s}_value"))
    both = pairs.join(side("left"), "left_id").join(side("right"), ["right_id", "family", "basis", "metric", "lower"])
    raw = relative_direction(F.col("left_value"), F.col("right_value"))
    direction = F.when(raw == "similar", raw).when(raw == "higher", F.when(F.col("lower"), "right_lower").otherwise("left_higher")).otherwise(F.when(F.col("lower"), "left_lower").otherwise("right_higher"))
    return both.select("left_id", "right_id", "family", "metric", "basis", direction.alias("direction"), "left_value", "right_value")


def incomplete_reasons(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Why a comparison is incomplete, in order; each side has eligible, and per family ``missing`` and ``partial``."""
    found = [F.when(~s["eligible"], f"{n}_coordinate_not_currently_eligible") for n, s in (("left", left), ("right", right))]
    for f in FAMILIES:
        a, b = left[f"{f}_missing"], right[f"{f}_missing"]
        found.append(F.when(a.isNotNull() | b.isNotNull(), F.concat_ws(":", F.lit(f), F.coalesce(a, F.lit("available")), F.coalesce(b, F.lit("available")))))
    for f in FAMILIES:
        found += [F.when(F.coalesce(s[f"{f}_partial"], F.lit(False)), f"{n}_{f}_partial_coverage") for n, s in (("left", left), ("right", right))]
    return F.array_compact(F.array(*found))


def compared(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """Pairs of sites of the read model with the reasons why their comparison is incomplete."""
    partial = {f: F.exists(f, lambda x: ~x["covered"]) for f in FAMILIES}
    facts = F.struct("eligible", *[F.col(f"{f}_missing") for f in FAMILIES], *[partial[f].alias(f"{f}_partial") for f in FAMILIES])
    side = lambda s: model.select(F.col("site_id").alias(f"{s}_id"), facts.alias(s))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    names = ["eligible", *[f"{f}_{x}" for x in ("missing", "partial") for f in FAMILIES]]
    reasons = incomplete_reasons(*[{n: F.col(f"{s}.{n}") for n in names} for s in ("left", "right")])
    return both.select("left_id", "right_id", (F.size(reasons) == 0).alias("complete"), reasons.alias("reasons"))
