"""Calibration evidence: the movement gate, the checks of an evidence package, and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a metadata field that mean nobody has reviewed it, and schemes of evidence addresses.
UNREVIEWED = ("unknown", "n/a", "na", "none", "tbd", "pending")
SCHEMES = ("https", "file", "s3", "gs", "az")


def gate_failures(r: dict[str, Column]) -> Column:
    """Names of the thresholds that a calibration report misses, in order."""
    return F.array_compact(
        F.array(
            F.when(r["held_out_locations"] < 3, "HELD_OUT_LOCATIONS"), F.when(r["directional_blocks"] < 192, "DIRECTIONAL_BLOCKS"), F.when(~r["independent_date_replication"], "INDEPENDENT_DATE_REPLICATION"),
            F.when(r["mdape"] > 0.35, "MDAPE"), F.when(r["wape"] > 0.35, "WAPE"), F.when(r["interval_coverage"] < 0.70, "INTERVAL_COVERAGE"), F.when(r["absolute_signed_wape"] > 0.15, "SIGNED_WAPE"),
            F.when(r["worst_stratum_signed_wape"] > 0.25, "STRATUM_BIAS"), F.when(~r["claim_inputs_complete"], "CLAIM_INPUTS"), F.when(~r["inside_applicability_envelope"], "APPLICABILITY"),
            F.when(~r["downstream_protocol_registered"], "DOWNSTREAM_PROTOCOL"),
        )
    )


def period_valid(start: Column, end: Column) -> Column:
    """Both are real days written as yyyy-mm-dd, in order."""
    real = lambda c: F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == c, F.lit(False))
    return real(start) & real(end) & F.coalesce(start <= end, F.lit(False))


def reviewed(license_id: Column, rights_ref: Column, *uris: Column) -> Column:
    named = lambda c: ~F.lower(F.trim(c)).isin(*UNREVIEWED)
    address = lambda c: c.rlike(rf"^(?i)({'|'.join(SCHEMES)}):") & ~c.rlike("^[^/]*//[^/]*@")
    out = named(license_id) & named(rights_ref)
    for uri in uris:
        out = out & address(uri)
    return F.coalesce(out, F.lit(False))


def package_failures(packages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """package_id and the failures of its evidence, in order.

    ``packages``: package_id, frozen_at (timestamp, null if unreadable), replicated.  ``artifacts``: package_id,
    artifact_id, sha256, kind, usage, provenance_uri, retained_uri, license_id, rights_ref, period_start, period_end.
    A package without artifacts, or with an empty required field, has no valid schema, and then nothing else is checked.
    """
    required = ("artifact_id", "sha256", "kind", "usage", "provenance_uri", "retained_uri", "license_id", "rights_ref", "period_start", "period_end")
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.length(c) > 0)
    has = lambda kind, usage: F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("usage") == usage)), F.lit(False))
    again = (F.col("kind") == "movement_truth") & (F.col("usage") == "independent_date_replication")
    # Roles of a file are counted per file first, so no package's artifacts are gathered.
    files = artifacts.groupBy("package_id", "sha256").agg(F.count_distinct("usage").alias("n")).groupBy("package_id").agg((F.max("n") > 1).alias("collision"))
    names = artifacts.groupBy("package_id", "artifact_id").agg(F.count(F.lit(1)).alias("n")).groupBy("package_id").agg((F.max("n") > 1).alias("repeated"))
    facts = artifacts.groupBy("package_id").agg(
        F.bool_and(whole).alias("whole"), F.bool_and(period_valid(F.col("period_start"), F.col("period_end"))).alias("periods"),
        F.bool_and(reviewed(F.col("license_id"), F.col("rights_ref"), F.col("provenance_uri"), F.col("retained_uri"))).alias("reviewed"),
        has("movement_truth", "training").alias("training"), has("movement_truth", "held_out_validation").alias("held_out"), has("exposure_geometry_truth", "held_out_validation").alias("geometry"),
        has("target_panel_truth", "held_out_validation").alias("panel"), has("downstream_validation_result", "held_out_validation").alias("downstream"),
        F.coalesce(F.bool_or(again), F.lit(False)).alias("again"), F.min(F.when(again, F.try_to_timestamp("period_start", F.lit("yyyy-MM-dd")))).alias("again_from"),
    )
    all_ = packages.join(facts, "package_id", "left").join(files, "package_id", "left").join(names, "package_id", "left")
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("frozen_at").isNull(), "INVALID_MODEL_FREEZE_TIME"), F.when(~c("periods"), "ARTIFACT_PERIOD_INVALID"), F.when(~c("reviewed"), "UNREVIEWED_PROVENANCE_OR_RIGHTS"),
            F.when(c("repeated"), "DUPLICATE_ARTIFACT_ID"), F.when(c("collision"), "ARTIFACT_ROLE_COLLISION"), F.when(~c("training"), "MISSING_TRAINING_MOVEMENT_TRUTH"), F.when(~c("held_out"), "MISSING_HELD_OUT_MOVEMENT_TRUTH"),
            F.when(~c("geometry"), "MISSING_HELD_OUT_EXPOSURE_GEOMETRY_TRUTH"), F.when(~c("panel"), "MISSING_HELD_OUT_TARGET_PANEL_TRUTH"), F.when(~c("downstream"), "MISSING_DOWNSTREAM_VALIDATION_RESULT"),
            F.when(c("replicated") & ~c("again"), "MISSING_INDEPENDENT_DATE_REPLICATION_EVIDENCE"), F.when(c("again_from") <= c("frozen_at"), "INDEPENDENT_DATE_NOT_POST_FREEZE"),
        )
    )
    schema = F.coalesce(c("whole"), F.lit(False))
    return all_.select("package_id", F.when(schema, found).otherwise(F.array(F.lit("INVALID_PACKAGE_SCHEMA"))).alias("package_failures"))


def promotion(failures: DataFrame, reports: DataFrame) -> DataFrame:
    """The decision per package; ``reports``: package_id, environment and the columns of ``gate_failures``.

    A package of test fixtures is never promoted.  Without a valid schema the report is not judged.
    """
    names = ("held_out_locations", "directional_blocks", "mdape", "wape", "interval_coverage", "absolute_signed_wape", "worst_stratum_signed_wape", "independent_date_replication", "claim_inputs_complete", "inside_applicability_envelope", "downstream_protocol_registered")
    joined = failures.join(reports, "package_id")
    readable = ~F.array_contains("package_failures", "INVALID_PACKAGE_SCHEMA")
    gate = F.when(readable, gate_failures({n: F.col(n) for n in names})).otherwise(F.array().cast("array<string>"))
    fixture = readable & (F.col("environment") == "test_fixture")
    valid, passed = F.size("package_failures") == 0, readable & (F.size("calibration_failures") == 0)
    return joined.withColumn("calibration_failures", gate).select("package_id", valid.alias("package_valid"), passed.alias("calibration_passed"), (valid & passed & ~fixture).alias("eligible"), "package_failures", fixture.alias("fixture"), "calibration_failures")


def used_twice(uses: DataFrame) -> DataFrame:
    """Features scored in more than one pillar, or both measured and scored; ``uses``: feature_id, role, pillar."""
    score, measured = F.col("role") == "score", F.col("role") == "measurement"
    found = uses.groupBy("feature_id").agg(F.count_distinct(F.when(score, F.coalesce("pillar", F.lit("")))).alias("pillars"), F.coalesce(F.bool_or(measured), F.lit(False)).alias("measured"))
    return found.where((F.col("pillars") > 1) | F.col("measured") & (F.col("pillars") > 0)).select("feature_id", "pillars", "measured")
