"""Which run a derivation builds on, the facts of its sources with their entities, and what it records of itself."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.ids import canonical_json

#: Columns of a fact that name entities, and the type under which each is looked up.
LOOKUPS = (("state", "state"), ("city", "city"), ("category", "category"), ("format_category", "format"), ("advertiser", "advertiser"), ("brand", "brand"))


def latest_run(runs: DataFrame, **where: str) -> DataFrame:
    """The succeeded run that ended last, ties to the larger id, one without an end after all others; at most one row."""
    chosen = runs.where(F.col("status") == "succeeded")
    for column, value in where.items():
        chosen = chosen.where(F.col(column) == value)
    return chosen.orderBy(F.desc_nulls_last("completed_at"), F.desc("run_id")).limit(1)


def of_run(facts: DataFrame, run_sources: DataFrame, run: DataFrame) -> DataFrame:
    """Facts of the very files that a run took in: source and checksum must both be the run's."""
    files = run_sources.join(F.broadcast(run.select("run_id")), "run_id", "left_semi").select("source_id", "sha256").distinct()
    return facts.join(files, ["source_id", "sha256"])


def with_entities(facts: DataFrame, aliases: DataFrame, version: str, lookups: tuple[tuple[str, str], ...] = LOOKUPS) -> DataFrame:
    """Facts with an entity id per looked-up column, null where a literal has no alias of that type and version.

    Aliases are few beside the facts; each look-up is a left join that Spark broadcasts if their size allows.
    """
    known = aliases.where(F.col("resolver_version") == version)
    out = facts
    for column, kind in lookups:
        one = known.where(F.col("entity_type") == kind).select(F.col("source_literal").alias(column), F.col("entity_id").alias(f"{column}_entity_id"))
        out = out.join(one, column, "left")
    return out


def unmapped(facts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How many facts lack an entity for each column that must have one; columns without a gap are left out."""
    counts = facts.agg(*[F.count_if(F.col(f"{c}_entity_id").isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns]))).where("n_missing > 0")


def run_counts(run_id: str, outputs: dict[str, DataFrame]) -> DataFrame:
    """A row for the audit of a run: its id and the rows of each of its outputs as a map."""
    counted = None
    for name, df in outputs.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "n")
        counted = part if counted is None else counted.union(part)
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("output", "n")))).alias("counts")).select(F.lit(run_id).alias("run_id"), F.lit("succeeded").alias("status"), "counts")


def binding_failures(packages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Packages whose context snapshot is missing or is not what they say; versions and fingerprints compare as they are, null with null."""
    names = ("feature_version", "resolver_version", "source_fingerprint", "resolution_fingerprint")
    held = snapshots.select("snapshot_id", F.lit(True).alias("__found"), *[F.col(n).alias(f"__{n}") for n in names])
    joined = packages.join(held, "snapshot_id", "left")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__{n}"))
    reason = F.when(F.col("__found").isNull(), "CALIBRATION_CONTEXT_SNAPSHOT_NOT_FOUND").when(~same, "CALIBRATION_CONTEXT_BINDING_MISMATCH")
    return joined.select("package_id", reason.alias("reason")).where("reason IS NOT NULL")


def pinned(reads: DataFrame, lock: DataFrame) -> DataFrame:
    """Reads (table, revision) that a resolution's lock (table, revision) does not list: sources and resolution exclude each other."""
    return reads.join(lock, ["table", "revision"], "left_anti")


def resolved_artifact(resolution: Column, artifacts: Column, fallback: Column) -> Column:
    """Struct of artifact and failure: the selected profile's artifact of a map by profile, else the fallback's; its snapshot must be the fallback's, its use context only."""
    chosen = F.coalesce(F.try_element_at(artifacts, resolution), fallback)
    failure = F.when(~chosen["snapshot_digest"].eqNullSafe(fallback["snapshot_digest"]), "SURVEY_SEGMENT_SOURCE_SNAPSHOT_MISMATCH").when(~chosen["decision_use"].eqNullSafe(F.lit("context_only")), "SURVEY_SEGMENT_DECISION_USE_INVALID")
    return F.struct(F.when(failure.isNull(), chosen).alias("artifact"), failure.alias("failure"))


#: What a settlement source's columns may be mapped to.
SETTLEMENT_FIELDS = ("feature_id", "building_count", "building_density", "degree_urbanisation", "population_estimate", "false_positive_probability", "place_code")
ROW_ID = "$fid"


def field_map(given: dict[str, str | None]) -> dict[str, str]:
    """A checked field map: known fields, named columns, none twice; without a column for the id it is the row's own."""
    for key, column in given.items():
        if key not in SETTLEMENT_FIELDS:
            raise ValueError(f"FIELD_MAP_KEY_INVALID:{key}")
        if column is not None and not column.strip():
            raise ValueError(f"FIELD_MAP_VALUE_REQUIRED:{key}")
    found = {"feature_id": ROW_ID} | {k: c.strip() for k, c in given.items() if c is not None}
    columns = [c for c in found.values() if c != ROW_ID]
    if len(set(columns)) != len(columns):
        raise ValueError("FIELD_MAP_DUPLICATE_SOURCE_COLUMN")
    return found


def mapped_fields(rows: DataFrame, fields: dict[str, str], row_id: Column) -> DataFrame:
    """The mapped columns under the names of their fields; a field that is not mapped is null."""
    of = lambda f: row_id if fields.get(f) == ROW_ID else F.col(f"`{fields[f]}`") if f in fields else F.lit(None).cast("string")
    return rows.select(*[of(f).alias(f) for f in SETTLEMENT_FIELDS])


def digest(value) -> str:
    """sha256 of canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def without_absent(value):
    """A JSON value with keys whose value is absent (``...``) left out, and null for absent items of lists."""
    if isinstance(value, list):
        return [None if v is ... else without_absent(v) for v in value]
    if isinstance(value, dict):
        return {k: without_absent(v) for k, v in value.items() if v is not ...}
    return value
