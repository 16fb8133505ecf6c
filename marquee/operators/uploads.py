"""Uploaded faces beside a plan: merge of provider answers, confirmation, and comparison with the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.geo import haversine

#: Kilometres; the radius that this comparison is stated in.
EARTH_KM = 6371.0
MOST_ROWS = 50


def format_name(c: Column) -> Column:
    """``dooh``, ``static`` or the trimmed lower-case text; empty is null."""
    bare = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.when(F.contains(bare, F.lit("digital")) | (bare == "dooh"), "dooh").when(F.contains(bare, F.lit("static")), "static").otherwise(bare)


def nearest_zone(lon: Column, lat: Column, zones: Column) -> Column:
    """Struct of km and zone_id of the nearest of an array of (zone_id, lon, lat) structs, ties by id; null without a coordinate or zone."""
    away = F.transform(zones, lambda z: F.struct(haversine(lon, lat, z["lon"], z["lat"], EARTH_KM).alias("km"), z["zone_id"].alias("zone_id")))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array_min(away))


def completeness(*fields: Column) -> Column:
    """Part of the fields that hold something."""
    return sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0)) / F.lit(float(len(fields)))


def rate_delta_percent(rate: Column, median: Column) -> Column:
    return F.when(median != 0, 100 * (rate - median) / median)


def comparison(rows: DataFrame, package: DataFrame, zones: Column) -> DataFrame:
    """Uploaded rows (asset_id, supplier, address, format, rate, lon, lat) against the package's sites (format, rate), with their order.

    The package is at most six sites; its median and formats are one row.
    """
    facts = package.agg(F.median("rate").alias("__median"), F.collect_set(format_name(F.col("format"))).alias("__formats"))
    kind = format_name(F.col("format"))
    fit = F.when(kind.isNull(), "unknown").when(F.array_contains("__formats", kind), "matches_package").otherwise("new_format")
    out = rows.join(F.broadcast(facts)).select(
        "asset_id", nearest_zone(F.col("lon"), F.col("lat"), zones).alias("z"), fit.alias("format_fit"), rate_delta_percent(F.col("rate"), F.col("__median")).alias("rate_delta_percent"),
        completeness(F.col("supplier"), F.col("address"), F.col("format"), F.col("rate"), F.when(F.col("lat").isNotNull(), F.col("lon"))).alias("completeness"),
    )
    return out.select("asset_id", F.col("z.zone_id").alias("zone_id"), F.col("z.km").alias("distance_km"), "format_fit", "rate_delta_percent", "completeness")


def comparison_order() -> list[Column]:
    """With a zone first, nearest first, formats of the package first, then by id."""
    return [F.col("distance_km").isNull(), F.col("distance_km"), F.col("format_fit") != "matches_package", F.col("asset_id")]


def selection_failure(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many ids were chosen, how many are unknown, and the reason to refuse them (none chosen, more than MOST_ROWS, unknown ids)."""
    counted = chosen.select("row_id").distinct().join(known.select("row_id", F.lit(True).alias("__known")).distinct(), "row_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__known").isNull()).alias("n_unknown"))
    reason = F.when(F.col("n") == 0, "NO_ROWS_SELECTED").when(F.col("n") > MOST_ROWS, "TOO_MANY_ROWS").when(F.col("n_unknown") > 0, "UNKNOWN_ROWS")
    return counted.select("n", "n_unknown", reason.alias("reason"))


def merged_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (row_id, address, lon, lat, status) with the best answer of providers (row_id, confidence, lon, lat, provider, failed) where they have no coordinate.

    A confirmed or corrected row is left alone; failures of all providers make a row ``failed``, a found coordinate waits
    for confirmation as ``proposed``.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("provider").alias("p"))
    best = answers.groupBy("row_id").agg(F.min_by(F.struct("lon", "lat", "confidence", "provider"), F.when(~F.col("failed"), rank)).alias("best"), F.bool_and("failed").alias("failed"))
    joined = rows.join(best, "row_id", "left")
    settled = F.col("status").isin("confirmed", "corrected") | F.col("lon").isNotNull()
    found = ~settled & F.col("best").isNotNull() & ~F.coalesce("failed", F.lit(True))
    status = F.when(found, "proposed").when(~settled & F.coalesce("failed", F.lit(False)), "failed").otherwise(F.col("status"))
    return joined.select("row_id", "address", F.when(found, F.col("best.lon")).otherwise(F.col("lon")).alias("lon"), F.when(found, F.col("best.lat")).otherwise(F.col("lat")).alias("lat"), status.alias("status"), F.when(found, F.col("best.provider")).alias("provider"))


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows after the user's decisions (row_id, action confirm/correct/reject, lon, lat): the last word on a coordinate."""
    d = decisions.select("row_id", "action", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    joined = rows.join(d, "row_id", "left")
    corrected, confirmed, rejected = (F.coalesce(F.col("action") == a, F.lit(False)) for a in ("correct", "confirm", "reject"))
    status = F.when(corrected, "corrected").when(confirmed & F.col("lon").isNotNull(), "confirmed").when(rejected, "rejected").otherwise(F.col("status"))
    lon = F.when(corrected, F.col("__lon")).when(~rejected, F.col("lon"))
    lat = F.when(corrected, F.col("__lat")).when(~rejected, F.col("lat"))
    return joined.select("row_id", "address", lon.alias("lon"), lat.alias("lat"), status.alias("status"), "provider")


def applied(rows: DataFrame) -> DataFrame:
    """Rows that may be used: confirmed or corrected, with a coordinate."""
    return rows.where(F.col("status").isin("confirmed", "corrected") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
