"""Evidence manifests: a package and the files of its artifacts, whose checksums are computed where the files are read."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import evidence

FAILURE = "artifact_id string, code string, expected string, actual string"
#: Columns of an artifact by its fields in the manifest.
FIELDS = {
    "artifact_id": "artifactId", "sha256": "sha256", "kind": "kind", "usage": "usage", "provenance_uri": "provenanceUri", "retained_uri": "retainedUri", "license_id": "licenseId", "rights_ref": "rightsRef",
    "period_start": "periodStart", "period_end": "periodEnd",
}


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, dict[str, str]]:
    """The package and the paths of its artifacts' files, against the manifest's folder; a bare package names no files."""
    raw = json.loads(spark.read.option("wholetext", True).text(path).first().value)
    if not isinstance(raw, dict):
        return {}, {}
    files = raw.get("artifactFiles") if isinstance(raw.get("artifactFiles"), dict) else {}
    return raw.get("package", raw), {k: v for k, v in files.items() if isinstance(v, str) and v.strip()}


def artifact_rows(spark: SparkSession, package: dict) -> DataFrame:
    """The package's artifacts as ``evidence.package_failures`` takes them."""
    rows = [(package.get("packageId"), *[a.get(f) for f in FIELDS.values()]) for a in package.get("artifacts") or []]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("package_id", *FIELDS)))


def artifact_failures(spark: SparkSession, path: str) -> DataFrame:
    """artifact_id, code, expected and actual checksum of each artifact whose file is not named, cannot be read or is another."""
    package, files = read_manifest(spark, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    expected = [(a["artifactId"], a["sha256"], files.get(a["artifactId"])) for a in package.get("artifacts") or []]
    there = {}
    for artifact, _, name in expected:
        if name is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)
            if store.exists(at) and not store.getFileStatus(at).isDirectory():
                there[artifact] = at.toString()
    hashed = [spark.read.format("binaryFile").load(p).select(F.lit(a).alias("artifact_id"), F.sha2("content", 256).alias("actual")) for a, p in there.items()]
    actual = reduce(DataFrame.union, hashed) if hashed else spark.createDataFrame([], "artifact_id string, actual string")
    wanted = spark.createDataFrame(expected, "artifact_id string, expected string, file string")
    code = F.when(F.col("file").isNull(), "ARTIFACT_FILE_MAPPING_MISSING").when(F.col("actual").isNull(), "ARTIFACT_FILE_UNREADABLE").when(F.col("actual") != F.col("expected"), "ARTIFACT_SHA256_MISMATCH")
    return wanted.join(actual, "artifact_id", "left").select("artifact_id", code.alias("code"), "expected", "actual").where("code IS NOT NULL")


def registerable(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """Whether a manifest's package is valid and all its files are what they should be, and what is wrong with it; one package, so its failures come to the driver."""
    package, _ = read_manifest(spark, path)
    frozen = spark.createDataFrame([(package.get("packageId"), package.get("frozenAt"), bool(package.get("replicated")))], "package_id string, frozen_at string, replicated boolean")
    frozen = frozen.withColumn("frozen_at", F.try_to_timestamp("frozen_at"))
    invalid = [x for r in evidence.package_failures(frozen, artifact_rows(spark, package)).collect() for x in r.package_failures]
    if invalid:
        return False, invalid
    return not (found := [f"{r.code}:{r.artifact_id}" for r in artifact_failures(spark, path).orderBy("artifact_id").collect()]), found
