"""Changing a plan: options for its sites and zones, replacement zones, and what two plans differ in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PILLARS = ("A", "D", "C", "P", "E")


def adjustment_options(sites: DataFrame, plans: DataFrame, flies: Column) -> DataFrame:
    """What may be done to each plan, as rows of action, subject, option and place in order.

    ``sites``: site_id, zone_id, rate and what ``flies`` (whether a site can serve the flight) needs.  ``plans``: plan_id
    and sites (array).  Actions: ``add`` (a free site of a zone of the plan, by zone and id), ``replace`` (of a chosen site
    by a free one of its zone, cheapest first), ``zone`` (one that the plan has no site in, by id).
    """
    usable = sites.where(flies).select("site_id", "zone_id", "rate")
    chosen = plans.select("plan_id", F.explode("sites").alias("chosen")).join(sites.select(F.col("site_id").alias("chosen"), "zone_id"), "chosen")
    zones = chosen.select("plan_id", "zone_id").distinct()
    # Free sites meet a plan through its zones; only the last part, zones without a site, needs every zone of the inventory.
    free = zones.join(usable, "zone_id").join(chosen.select("plan_id", F.col("chosen").alias("site_id")), ["plan_id", "site_id"], "left_anti")
    row = lambda df, action, subject, option, *order: df.select("plan_id", F.lit(action).alias("action"), subject.alias("subject"), option.alias("option"), F.struct(*order).alias("o"))
    none = F.lit(None).cast("double")
    add = row(free, "add", F.col("zone_id"), F.col("site_id"), none.alias("n"), F.concat_ws("|", "zone_id", "site_id").alias("t"))
    swap = row(chosen.join(free, ["plan_id", "zone_id"]), "replace", F.col("chosen"), F.col("site_id"), F.col("rate").cast("double").alias("n"), F.col("site_id").alias("t"))
    every = usable.select("zone_id").distinct()
    other = plans.select("plan_id").join(F.broadcast(every)).join(zones, ["plan_id", "zone_id"], "left_anti")
    zone = row(other, "zone", F.lit(None).cast("string"), F.col("zone_id"), none.alias("n"), F.col("zone_id").alias("t"))
    scope = F.when(F.col("action") == "replace", F.col("subject"))
    place = F.row_number().over(Window.partitionBy("plan_id", "action", scope).orderBy("o"))
    return add.union(swap).union(zone).select("plan_id", "action", "subject", "option", place.alias("place"))


def zone_swaps(sites: DataFrame, plans: DataFrame, flies: Column) -> DataFrame:
    """Packages with one zone left out and one usable site of another zone put in: plan_id, dropped, target, package_id, sites."""
    zone_of = plans.select("plan_id", F.explode("sites").alias("site_id")).join(sites.select("site_id", "zone_id"), "site_id")
    own = zone_of.groupBy("plan_id").agg(F.collect_list(F.struct("site_id", "zone_id")).alias("own"))
    dropped = own.select("plan_id", "own", F.explode(F.array_distinct(F.transform("own", lambda x: x["zone_id"]))).alias("dropped"))
    usable = sites.where(flies).select(F.col("site_id").alias("added"), F.col("zone_id").alias("target"))
    # Plans are a handful; each meets every usable site outside its zones.
    pairs = usable.join(F.broadcast(dropped), ~F.exists("own", lambda x: x["zone_id"] == F.col("target")))
    kept = F.transform(F.filter("own", lambda x: x["zone_id"] != F.col("dropped")), lambda x: x["site_id"])
    swapped = pairs.select("plan_id", "dropped", "target", F.array_append(kept, F.col("added")).alias("sites"))
    return swapped.select("plan_id", "dropped", "target", F.array_join(F.array_sort("sites"), "|").alias("package_id"), "sites")


def replacements(swaps: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """The best swap per ``keys`` (plan and dropped zone, with the target zone for a zone the user named).

    ``measured`` has package_id, valid, fit, context_score and cost of every swapped package, judged against the plan's own cohort.
    """
    order = F.struct((~F.col("valid")).alias("v"), (-F.coalesce("fit", F.lit(-1e18))).alias("f"), (-F.coalesce("context_score", F.lit(-1e18))).alias("c"), F.col("cost"), F.col("package_id"))
    joined = swaps.join(measured.select("package_id", "valid", "fit", "context_score", "cost"), "package_id")
    picked = joined.groupBy(*keys).agg(F.min_by(F.struct("target", "package_id", "valid", "fit", "cost"), order).alias("m"))
    return picked.select(*keys, *[F.col(f"m.{c}").alias(c) for c in ("target", "package_id", "valid", "fit", "cost") if c not in keys])


def internal_replacements(ranked: DataFrame, recommended: str, n: int = 2) -> DataFrame:
    """The next best candidates after the recommended one."""
    return ranked.where(F.col("package_id") != recommended).orderBy("rank").limit(n)


def plan_deltas(pairs: DataFrame) -> DataFrame:
    """What changes from one plan to another; ``pairs`` has structs ``a`` and ``b`` of objective, comparability_key, low, base, high, cost, fit, evidence_score, sites, zones and the pillars."""
    a, b = F.col("a"), F.col("b")
    comparable = (a["objective"] == b["objective"]) & a["comparability_key"].eqNullSafe(b["comparability_key"])
    whole = lambda x: x["low"].isNotNull() & x["base"].isNotNull() & x["high"].isNotNull()
    reason = F.when(~comparable, "INCOMPARABLE_DELIVERY_BASIS").when(~whole(a) | ~whole(b), "OBJECTIVE_DELIVERY_UNAVAILABLE")
    gain = F.when(reason.isNull(), b["base"] - a["base"])
    cost = b["cost"] - a["cost"]
    way = lambda x: F.when(x > 0, "increases").when(x < 0, "decreases").otherwise("is unchanged")
    text = F.when(reason.isNotNull(), "Audience delivery is shown side by side because the campaign settings changed.").otherwise(F.concat(F.lit("Expected audience delivery "), way(gain), F.lit(" while cost "), way(cost), F.lit(".")))
    changed = lambda f: F.array_sort(F.concat(F.array_except(a[f], b[f]), F.array_except(b[f], a[f])))
    moved = F.array_compact(F.array(*[F.when(~a[p].eqNullSafe(b[p]), p) for p in PILLARS]))
    return pairs.select(
        "pair_id", comparable.alias("comparable"), reason.alias("reason"), cost.alias("cost"), (b["fit"] - a["fit"]).alias("fit"), (b["evidence_score"] - a["evidence_score"]).alias("evidence_score"), gain.alias("delivery"),
        changed("sites").alias("changed_sites"), changed("zones").alias("changed_zones"), moved.alias("pillars"), text.alias("trade_off"),
    )


def request_staleness(valid: Column, measured: Column, replayed: Column, estimate: Column, fingerprint: Column, sites: Column, replay_sites: Column) -> Column:
    """Why a request cannot be made from an applied plan, or null."""
    stale = ~measured | ~replayed | ~estimate.eqNullSafe(fingerprint) | ~F.array_sort(sites).eqNullSafe(F.array_sort(replay_sites))
    return F.when(~valid, "PACKAGE_INVALID").when(stale, "STALE_APPLIED_PLAN")


def share_range(low: Column, base: Column, high: Column, universe: Column) -> Column:
    """Struct of the range as per cent of its universe."""
    part = lambda x: 100 * x / F.nullif(universe, F.lit(0))
    return F.struct(part(low).alias("low"), part(base).alias("base"), part(high).alias("high"))
