"""Reviewed assertions: coordinates, owners, airport overrides and site decisions, their ids, and how they are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import ids, text

#: Rights, the kinds of sources that can give them, and the code otherwise.
RIGHTS_OF = (
    ("customer_captured", ("customer_capture", "field_survey"), "CUSTOMER_CAPTURED_RIGHTS_REQUIRE_CAPTURE_OR_FIELD_SURVEY"),
    ("open_licensed", ("open_dataset",), "OPEN_LICENSED_RIGHTS_REQUIRE_OPEN_DATASET"),
    ("provider_derived", ("licensed_provider",), "PROVIDER_DERIVED_RIGHTS_REQUIRE_LICENSED_PROVIDER"),
)


def coordinate_failure(c: dict[str, Column]) -> Column:
    """The first reason to refuse a coordinate assertion, or null."""
    approved, rights = c["status"] == "approved", c["rights"]
    blank = lambda x: F.coalesce(F.length(F.trim(x)), F.lit(0)) == 0
    out = F.when(~(c["lat"].between(-90, 90) & c["lon"].between(-180, 180)), "COORDINATE_OUT_OF_RANGE").when(c["accuracy"] < 0, "ACCURACY_INVALID")
    for right, kinds, code in RIGHTS_OF:
        out = out.when((rights == right) & ~c["source_kind"].isin(*kinds), code)
    return (
        out.when((rights == "unknown") & approved, "UNKNOWN_SPATIAL_RIGHTS_CANNOT_BE_APPROVED")
        .when(approved & c["accuracy"].isNull(), "APPROVED_COORDINATE_ACCURACY_REQUIRED")
        .when(approved & blank(c["artifact"]), "APPROVED_COORDINATE_SOURCE_ARTIFACT_REQUIRED")
        .when(approved & rights.isin("customer_captured", "open_licensed") & blank(c["license"]), "APPROVED_MAPLIBRE_SPATIAL_LICENSE_REQUIRED")
    )


def renderer(status: Column, rights: Column) -> Column:
    """Where an accepted coordinate may be drawn."""
    approved = status == "approved"
    return F.when(approved & rights.isin("customer_captured", "open_licensed"), "maplibre").when(approved & (rights == "provider_derived"), "provider_only").otherwise("none")


def coordinate_id(site: Column, lat: Column, lon: Column, source: Column, artifact: Column, revision: Column) -> Column:
    fixed = lambda x: F.format_string("%.8f", x.cast("double"))
    return ids.stable_id("coordinate", site, fixed(lat), fixed(lon), source, F.coalesce(F.nullif(F.trim(artifact), F.lit("")), F.lit("")), revision)


def owner_id(name_key: Column, namespace: Column) -> Column:
    return ids.stable_id("owner", namespace, name_key)


def owner_assertions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with owner, alias and assertion ids, and refused ones (no letter or digit in the name); columns site_id, owner_name, namespace, source_id, revision, status."""
    keyed = rows.withColumn("owner_key", text.entity_literal(text.nfkc(F.col("owner_name"))))
    owner = owner_id(F.col("owner_key"), F.col("namespace"))
    shown = text.source_text(F.col("owner_name"))
    good = keyed.where(F.col("owner_key").isNotNull()).select(
        ids.stable_id("owner-assertion", F.col("site_id"), F.col("source_id"), F.col("revision")).alias("assertion_id"), owner.alias("owner_id"), ids.stable_id("owner-alias", owner, shown, F.col("source_id"), F.col("revision")).alias("alias_id"),
        "site_id", shown.alias("canonical_name"), "owner_key", "status",
    )
    return good, keyed.where(F.col("owner_key").isNull()).drop("owner_key").withColumn("reason", F.lit("MEDIA_OWNER_NORMALIZED_KEY_REQUIRED"))


def stable_owners(owners: DataFrame, new: DataFrame) -> DataFrame:
    """Owners with the new ones added: an owner that is known stays as it is, of several new rows the smallest name stands."""
    fresh = new.groupBy("owner_id").agg(F.min("canonical_name").alias("canonical_name")).join(owners.select("owner_id"), "owner_id", "left_anti")
    return owners.select("owner_id", "canonical_name").union(fresh)


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target with ``columns`` taken from the change of the same key, also where that is null; ``changes`` has a row per key at most."""
    named = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(named, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def manual_first(assertions: DataFrame, manual: DataFrame) -> DataFrame:
    """Airport assertions (record_id, literal, airport_id, method) with manual aliases (alias_id, literal, airport_id) before any other; of several the lowest alias id."""
    best = manual.groupBy(F.trim("literal").alias("__literal")).agg(F.min_by("airport_id", "alias_id").alias("__airport"))
    joined = assertions.join(best, F.trim("literal") == F.col("__literal"), "left")
    hit = F.col("__airport").isNotNull()
    return joined.select("record_id", "literal", F.when(hit, F.col("__airport")).otherwise(F.col("airport_id")).alias("airport_id"), F.when(hit, "manual_review").otherwise(F.col("method")).alias("method"))


def alias_counts(rows: DataFrame) -> DataFrame:
    """Per kind and literal its rows and airport; a literal of several airports is a collision and names none."""
    ends = rows.groupBy("kind", "literal").agg(F.count(F.lit(1)).alias("n_rows"), F.min("airport_id").alias("a"), F.max("airport_id").alias("b"))
    return ends.select("kind", "literal", "n_rows", F.when(F.col("a") == F.col("b"), F.col("a")).alias("airport_id"), (F.col("a") != F.col("b")).alias("collision"))


def with_assertions(facts: DataFrame, assertions: DataFrame, version: str) -> DataFrame:
    """Facts with the airport asserted for their scope, source, file and record by one resolver version."""
    keys = ["scope", "source_id", "sha256", "record_id"]
    return facts.join(assertions.where(F.col("resolver_version") == version).select(*keys, F.col("airport_id")), keys, "left")


def decision_failure(status: Column, method: Column, source: Column, revision: Column) -> Column:
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return F.when(~status.isin("confirmed", "rejected"), "DECISION_STATUS_INVALID").when(~method.isin("field_verification", "authoritative_registry", "manual_review"), "DECISION_METHOD_INVALID").when(empty(source) | empty(revision), "DECISION_EVIDENCE_REQUIRED")
