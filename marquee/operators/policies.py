"""Field policies, licences, and normal forms of open map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text

#: Operating states, road classes and advertising types that are taken over.
OPERATING = ("open", "temporarily_closed", "permanently_closed")
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "unclassified", "service", "pedestrian", "footway", "steps", "path", "track", "cycleway", "bridleway", "unknown",
)
ADVERTISING = ("billboard", "screen", "board", "totem")


def expired(now: Column, persistence: Column, expires_at: Column) -> Column:
    return (persistence == "DELETE_AT") & F.coalesce(expires_at <= now, F.lit(False))


def renderable(p: Column, surface: Column, now: Column) -> Column:
    """Whether a field may be drawn on a surface.

    ``p`` is a struct of persistence, expires_at, surfaces (array), purposes (array), product, content_class,
    attribution_id, legal_approval_id and approval_id.
    """
    derived = (p["product"] == "google.places-aggregate.v1") & (p["content_class"] == "GOOGLE_POI_COUNT") & (p["persistence"] == "APPROVED_DERIVED_VALUE") & (F.length(p["legal_approval_id"]) > 0) & (p["approval_id"] == p["legal_approval_id"])
    content = p["content_class"] == "GOOGLE_MAPS_CONTENT"
    open_map = surface == "MAPLIBRE"
    usable = ~expired(now, p["persistence"], p["expires_at"]) & F.array_contains(p["surfaces"], surface)
    allowed = F.when(open_map & p["product"].startswith("google."), F.coalesce(derived, F.lit(False))).when(open_map & content, F.lit(False)).when(content & (F.length(F.coalesce(p["attribution_id"], F.lit(""))) == 0), F.lit(False)).otherwise(F.lit(True))
    return F.coalesce(usable & allowed, F.lit(False))


def projectable(p: Column, surface: Column, purpose: Column, now: Column) -> Column:
    return renderable(p, surface, now) & F.coalesce(F.array_contains(p["purposes"], purpose), F.lit(False))


def scene(fields: DataFrame, surface: str, purpose: str, now: Column) -> DataFrame:
    """Fields (feature_id, field, value, policy) of a scene; a value that may not be shown is null with the field named as withheld."""
    ok = projectable(F.col("policy"), F.lit(surface), F.lit(purpose), now)
    return fields.select("feature_id", "field", F.when(ok, F.col("value")).alias("value"), (~ok).alias("withheld"))


def licence_coverage(features: DataFrame, sources: str) -> DataFrame:
    """Counts over features with an array of (dataset, license) structs: source items, items with a licence, features with all of them."""
    has = F.filter(sources, lambda s: F.length(F.coalesce(s["license"], F.lit(""))) > 0)
    return features.agg(F.coalesce(F.sum(F.size(sources)), F.lit(0)).alias("n_items"), F.coalesce(F.sum(F.size(has)), F.lit(0)).alias("n_licensed"), F.count_if((F.size(has) == F.size(sources)) & (F.size(sources) > 0)).alias("n_whole"), F.count(F.lit(1)).alias("n_features"))


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n_rows"))


def manifest(rows: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Per key a JSON array of objects in order."""
    item = F.struct(*order, *[c for c in fields if c not in order])
    ordered = F.array_sort(F.collect_list(item))
    return rows.groupBy(*keys).agg(ordered.alias("a")).select(*keys, F.to_json(F.transform("a", lambda x: F.struct(*[x[c].alias(c) for c in fields])), {"ignoreNullFields": "false"}).alias("manifest"))


def place(properties: Column, lon: Column, lat: Column) -> tuple[dict[str, Column], Column]:
    """Columns of a place feature and the reason to reject it; ``properties`` is JSON text."""
    get = lambda name: text.source_text(F.get_json_object(properties, f"$.{name}"))
    version = get("version").try_cast("double")
    confidence = get("confidence").try_cast("double")
    status = F.lower(get("operating_status"))
    items = F.from_json(F.get_json_object(properties, "$.sources"), "array<struct<dataset:string,license:string,record_id:string>>")
    reason = (
        F.when(get("id").isNull(), "FEATURE_ID_REQUIRED").when(lon.isNull() | lat.isNull() | ~lon.between(-180, 180) | ~lat.between(-90, 90), "PLACE_COORDINATE_INVALID")
        .when((confidence < 0) | (confidence > 1), "PLACE_CONFIDENCE_INVALID").when(version.isNull() | (version < 0) | (version != F.floor(version)), "FEATURE_VERSION_INVALID")
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, "SOURCES_REQUIRED").when(F.exists(items, lambda s: text.source_text(s["dataset"]).isNull()), "SOURCE_DATASET_REQUIRED")
    )
    columns = {"feature_id": get("id"), "version": version.cast("long"), "name": get("name"), "category": get("basic_category"), "confidence": confidence, "operating_status": F.when(status.isin(*OPERATING), status), "sources": items}
    return columns, reason


def road(properties: Column, line: Column, classes: tuple[str, ...] = ROAD_CLASSES) -> tuple[dict[str, Column], Column]:
    """Columns of a road feature and the reason to reject it; ``line`` is an array of [lon, lat]."""
    get = lambda name: text.source_text(F.get_json_object(properties, f"$.{name}"))
    kind = F.coalesce(F.lower(get("class")), F.lit("unknown"))
    wrong = F.exists(line, lambda p: (F.size(p) < 2) | ~F.coalesce(F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90), F.lit(False)))
    reason = F.when(get("id").isNull(), "FEATURE_ID_REQUIRED").when(~kind.isin(*classes), "ROAD_CLASS_INVALID").when(line.isNull(), "ROAD_LINESTRING_REQUIRED").when(wrong, "ROAD_COORDINATE_INVALID").when(F.size(line) < 2, "ROAD_LINESTRING_TOO_SHORT")
    return {"feature_id": get("id"), "name": get("name"), "road_class": kind, "subclass": get("subclass")}, reason


def advertising_type(advertising: Column, man_made: Column) -> Column:
    """The type of an advertising feature, null for others."""
    name = lambda c: F.translate(text.entity_literal(c), " ", "_")
    return F.when(name(advertising).isin(*ADVERTISING), name(advertising)).when(name(man_made) == "advertising", "advertising")


def representative_point(points: Column, is_point: Column) -> Column:
    """Struct of lon, lat and method: the point itself, the mean of all vertices, or unavailable; ``points`` is an array of [lon, lat]."""
    real = F.filter(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    mean = lambda k: F.aggregate(real, F.lit(0.0), lambda a, p: a + p[k]) / F.nullif(F.size(real), F.lit(0))
    return F.struct(mean(0).alias("lon"), mean(1).alias("lat"), F.when(F.coalesce(F.size(real), F.lit(0)) <= 0, "unavailable").when(is_point, "point").otherwise("vertex_mean").alias("method"))
