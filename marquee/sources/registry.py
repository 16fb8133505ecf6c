"""Registered sources: specifications, checksums, licences, and files written for other programs."""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.ids import canonical_json

#: How a source may be got.
ACQUISITION = ("download", "api", "manual")


@dataclass(frozen=True)
class SheetSpec:
    """One sheet of a workbook: where its cells stand and how many rows it has."""

    sheet: str
    layout: str
    expected_rows: int
    year: int | None = None
    superseded_years: tuple[int, ...] = ()


@dataclass(frozen=True)
class SourceSpec:
    """A file with its checksum and sheets."""

    source_id: str
    file_name: str
    sha256: str
    sheets: tuple[SheetSpec, ...] = ()


@dataclass(frozen=True)
class OpenSource:
    """An open source: who gives it, under which licence, and whether it is used."""

    source_id: str
    publisher: str
    license_id: str
    acquisition: str
    enabled: bool = True
    roles: tuple[str, ...] = field(default=())


def source_table(spark: SparkSession, sources: tuple[OpenSource, ...]) -> DataFrame:
    """The registry as a frame; an unknown way of acquisition or a repeated id is an error."""
    names = [s.source_id for s in sources]
    if len(set(names)) != len(names):
        raise ValueError("DUPLICATE_SOURCE_ID")
    if wrong := [s.source_id for s in sources if s.acquisition not in ACQUISITION]:
        raise ValueError(f"ACQUISITION_MODE_INVALID:{wrong[0]}")
    rows = [(s.source_id, s.publisher, s.license_id, s.acquisition, s.enabled, list(s.roles)) for s in sources]
    return spark.createDataFrame(rows, "source_id string, publisher string, license_id string, acquisition string, enabled boolean, roles array<string>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and sha256 of the files below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, specs: tuple[SourceSpec, ...]) -> DataFrame:
    """Per specification whether its file is there with its checksum: status ok, missing or changed."""
    wanted = spark.createDataFrame([(s.source_id, s.file_name, s.sha256) for s in specs], "source_id string, file_name string, expected string")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "changed").otherwise("ok")
    return wanted.join(checksums(spark, path), "file_name", "left").select("source_id", "file_name", "expected", "sha256", status.alias("status"))


def require_verified(spark: SparkSession, path: str, specs: tuple[SourceSpec, ...]) -> None:
    """An error that names the first source whose file is missing or changed; a row per specification comes to the driver."""
    for row in verified(spark, path, specs).where("status <> 'ok'").orderBy("source_id").collect():
        raise ValueError(f"SOURCE_CHECKSUM_{row.status.upper()}:{row.source_id}")


def sheet_rows(workbooks: DataFrame, source: SourceSpec, spec: SheetSpec) -> DataFrame:
    """Rows of one sheet, as ``read_workbooks`` gives them, with source_id, and with an error if their number is not the specification's."""
    from marquee.operators.parse import expect_rows

    rows = workbooks.where(F.col("sheet") == spec.sheet).withColumn("source_id", F.lit(source.source_id))
    return expect_rows(rows, spec.expected_rows)


def artifact(source: OpenSource, sha256: str, n_bytes: int, release: str, retrieved_at: str) -> dict:
    """The descriptor under which a landed file is registered, with its id; a licence, a checksum and a use that is permitted are required."""
    if not source.enabled:
        raise ValueError(f"SOURCE_DISABLED:{source.source_id}")
    if not source.license_id.strip():
        raise ValueError(f"SOURCE_LICENSE_REQUIRED:{source.source_id}")
    if len(sha256) != 64 or set(sha256) - set("0123456789abcdef"):
        raise ValueError("ARTIFACT_SHA256_INVALID")
    if n_bytes <= 0:
        raise ValueError("ARTIFACT_EMPTY")
    told = {"source_id": source.source_id, "license_id": source.license_id, "sha256": sha256, "n_bytes": n_bytes, "release": release, "retrieved_at": retrieved_at}
    return told | {"artifact_id": "artifact:" + hashlib.sha256(canonical_json(told).encode()).hexdigest()[:32]}


def copy_text(df: DataFrame) -> Column:
    r"""One line per row for a database's bulk load: tabs between fields, ``\N`` for null, backslash escapes; a number that is not finite is an error."""
    fields = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            bad = F.isnan(c) | (F.abs(c) == math.inf)
            c = F.when(bad, F.raise_error(F.lit(f"NON_FINITE_NUMBER:{name}")).cast(kind)).otherwise(c)
        text = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        fields.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("\t", *fields)


def write_copy(df: DataFrame, path: str) -> None:
    df.select(copy_text(df).alias("value")).write.mode("errorifexists").text(path)


def swap_folder(df: DataFrame, path: str) -> None:
    """Write a frame beside a folder and put it in the folder's place; the old one comes back if that fails.

    The folder's file system must rename folders (HDFS and local do; object stores copy, where a table format is the better way).
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    target, new, old = hadoop(path), hadoop(f"{path}.{mark}.new"), hadoop(f"{path}.{mark}.old")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(new.toString())
    had = store.exists(target)
    if had and not store.rename(target, old):
        raise OSError(f"SWAP_FAILED:{path}")
    if not store.rename(new, target):
        if had:
            store.rename(old, target)
        raise OSError(f"SWAP_FAILED:{path}")
    if had:
        store.delete(old, True)


def canonical_rows(df: DataFrame) -> Column:
    """A row as JSON with sorted keys, nulls kept, numbers finite (an error otherwise)."""
    fields = []
    for name, kind in sorted(df.dtypes):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == math.inf), F.raise_error(F.lit(f"NON_FINITE_NUMBER:{name}")).cast(kind)).otherwise(c)
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
