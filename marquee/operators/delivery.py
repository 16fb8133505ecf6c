"""Which inputs a package may use, what may then be claimed, and what it delivers for its objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Claims from the weakest to the strongest.
CLAIMS = ("context", "activity_potential", "movement", "general_ots", "target_ots", "scenario_target_reach", "calibrated_target_reach")
#: What each objective measures.
METRICS = {"broad_reach": "target_reach", "influential_core": "influence_weighted_reached_mass", "near_conversion": "serviceable_target_reach"}


def compatible_inputs(scopes: DataFrame, targets: DataFrame, sources: DataFrame, weights: DataFrame) -> DataFrame:
    """Per scope whether universe, allocation, reach, serviceability and influence inputs can be used.

    ``scopes``: scope_id, sector, geography, flight_start, flight_end, allocation_source, assumption, sensitivity.
    ``targets``: scope_id, universe_source, qi_source, serviceability_source.  ``sources``: source_id, kind, sector,
    geography, product_scope, period_start, period_end.  ``weights``: scope_id, weight, qi (panel members).

    A source fits if its kind, sector, geography and product scope are the scope's and its period spans the flight.
    All targets' sources must fit; serviceability and influence need one source for all, influence a positive
    denominator and both assumptions named as well.
    """
    kinds = (("universe_source", "target_universe"), ("qi_source", "influence"), ("serviceability_source", "serviceability"))
    asked = F.array(*[F.struct(F.col(c).alias("source_id"), F.lit(k).alias("wanted")) for c, k in kinds])
    uses = targets.select("scope_id", F.inline(asked)).union(scopes.select("scope_id", F.col("allocation_source"), F.lit("target_allocation")))
    scope = scopes.select("scope_id", *[F.col(c).alias(f"s_{c}") for c in ("sector", "geography", "flight_start", "flight_end")])
    # Uses are counted per source before the joins: targets repeat their sources.
    counted = uses.groupBy("scope_id", "source_id", "wanted").agg(F.count(F.lit(1)).alias("n")).join(scope, "scope_id").join(sources, "source_id", "left")
    fits = F.coalesce(
        (F.col("kind") == F.col("wanted")) & (F.col("sector") == F.col("s_sector")) & (F.col("geography") == F.col("s_geography")) & (F.col("product_scope") == F.col("s_sector"))
        & (F.col("period_start") <= F.col("s_flight_start")) & (F.col("period_end") >= F.col("s_flight_end")),
        F.lit(False),
    )
    of = lambda kind, x: F.when(F.col("wanted") == kind, x)
    checked = counted.withColumn("fits", fits).groupBy("scope_id").agg(
        *[F.coalesce(F.bool_and(of(k, F.col("fits"))), F.lit(False)).alias(k) for k in ("target_universe", "target_allocation", "influence", "serviceability")],
        *[F.count_distinct(of(k, F.coalesce("source_id", F.lit("")))).alias(f"n_{k}") for k in ("influence", "serviceability")],
    )
    mass = weights.groupBy("scope_id").agg(F.sum(F.col("weight") * F.col("qi")).alias("mass"))
    named = (F.length(F.coalesce("assumption", F.lit(""))) > 0) & (F.length(F.coalesce("sensitivity", F.lit(""))) > 0)
    joined = scopes.select("scope_id", named.alias("named")).join(checked, "scope_id", "left").join(mass, "scope_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return joined.select(
        "scope_id", yes("target_universe").alias("universe_ok"), yes("target_allocation").alias("allocation_ok"), (yes("target_universe") & yes("target_allocation")).alias("reach_ok"),
        (yes("serviceability") & (F.coalesce("n_serviceability", F.lit(0)) == 1)).alias("serviceability_ok"),
        (yes("influence") & (F.coalesce("n_influence", F.lit(0)) == 1) & (F.coalesce("mass", F.lit(0.0)) > 0) & F.col("named")).alias("influence_ok"),
    )


def permits(highest: Column, wanted: str) -> Column:
    """Whether a ceiling admits a claim."""
    return F.array_position(F.array(*[F.lit(c) for c in CLAIMS]), highest) >= CLAIMS.index(wanted) + 1


def permitted_scenario(highest: Column, failure: Column, influence_ok: Column, serviceability_ok: Column) -> dict[str, Column]:
    """The columns of a measured scenario with what may not be claimed as null.

    Nothing below target views; views alone below reach or when the panel failed; influence and serviceable reach
    only on fitting inputs.
    """
    views, reach = permits(highest, "target_ots"), permits(highest, "scenario_target_reach")
    shown = reach & failure.isNull()
    return {
        "target_chances": F.when(views, F.col("target_chances")), "reach": F.when(shown, F.col("reach")), "frequency": F.when(shown, F.col("frequency")),
        "influence_mass": F.when(shown & influence_ok, F.col("influence_mass")), "influence_capture": F.when(shown & influence_ok, F.col("influence_capture")),
        "serviceable_reach": F.when(shown & serviceability_ok, F.col("serviceable_reach")), "failure": F.when(reach, failure),
    }


def selected_claim(highest: Column, reaches: Column, target_views: Column, general_views: Column, movement: Column, activity: Column) -> Column:
    """Struct of kind and value: the strongest claim that is admitted and has its numbers; ``reaches`` is an array over low, base, high."""
    claim = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    whole = F.forall(reaches, lambda x: x.isNotNull())
    return (
        F.when(permits(highest, "scenario_target_reach") & whole, claim("scenario_target_reach", F.get(reaches, F.lit(1))))
        .when(permits(highest, "target_ots") & target_views.isNotNull(), claim("target_ots", target_views))
        .when(permits(highest, "general_ots"), claim("general_ots", general_views))
        .when(permits(highest, "movement"), claim("movement", movement))
        .when(permits(highest, "activity_potential") & activity.isNotNull(), claim("activity_potential", activity))
        .otherwise(claim("unavailable", F.lit(None)))
    )


def objective_delivery(objective: Column, ok: dict[str, Column], kind: Column, evidence: dict[str, Column], values: dict[str, Column]) -> Column:
    """Struct of metric, low, base, high and reason (null if eligible).

    ``ok``: reach, influence, serviceability (fitting inputs).  ``kind``: the claim.  ``evidence``: the same names,
    null where a result has none.  ``values``: by metric, arrays over low, base, high.
    """
    metric = F.element_at(F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair]), objective)
    core, near = objective == "influential_core", objective == "near_conversion"
    v = F.when(core, values["influence_weighted_reached_mass"]).when(near, values["serviceable_target_reach"]).otherwise(values["target_reach"])
    low, base, high = (F.get(v, F.lit(k)) for k in range(3))
    reason = (
        F.when(~ok["reach"], "TARGET_BASIS_INCOMPATIBLE")
        .when(~kind.isin("scenario_target_reach", "calibrated_target_reach") | evidence["reach"].isNull(), "UNIQUE_REACH_UNAVAILABLE")
        .when(core & (~ok["influence"] | evidence["influence"].isNull()), "INFLUENCE_PROFILE_INCOMPATIBLE")
        .when(near & (~ok["serviceability"] | evidence["serviceability"].isNull()), "SERVICEABILITY_PROFILE_INCOMPATIBLE")
        .when(low.isNull() | base.isNull() | high.isNull(), "OBJECTIVE_DELIVERY_UNAVAILABLE")
        .when(~((low <= base) & (base <= high)), "INCOHERENT_OBJECTIVE_RANGE")
    )
    shown = lambda x: F.when(reason.isNull(), x)
    return F.struct(metric.alias("metric"), shown(low).alias("low"), shown(base).alias("base"), shown(high).alias("high"), reason.alias("reason"))


def source_ids(*arrays: Column) -> Column:
    """Distinct ids of several arrays, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*arrays))))


def comparability_key(fields: dict[str, Column]) -> Column:
    """Canonical JSON of the fields by name: two results compare only if these agree."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
