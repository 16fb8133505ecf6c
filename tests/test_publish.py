"""Manifests, workbook structure and publication."""

import hashlib
import json

import pytest

from marquee import publish
from marquee.operators import survey
from marquee.sources import manifest
from marquee.sources.runstore import RunStore


def artifact(name, data, kind, usage, **changed):
    sha = hashlib.sha256(data).hexdigest()
    return {"artifactId": name, "sha256": sha, "kind": kind, "usage": usage, "provenanceUri": "https://a.example/x", "retainedUri": "s3://b/x", "licenseId": "L1", "rightsRef": "R1", "periodStart": "2026-01-01", "periodEnd": "2026-02-01"} | changed


def test_manifest_files(spark, tmp_path):
    data = {"a": b"one", "b": b"two", "c": b"three", "d": b"four"}
    for n, x in data.items():
        (tmp_path / f"{n}.bin").write_bytes(x)
    (tmp_path / "b.bin").write_bytes(b"another")
    (tmp_path / "folder").mkdir()
    artifacts = [artifact(n, x, "movement_truth", "training") for n, x in data.items()] + [artifact("e", b"5", "movement_truth", "training")]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"package": {"packageId": "p", "artifacts": artifacts}, "artifactFiles": {"a": "a.bin", "b": "b.bin", "c": "missing.bin", "e": "folder", "d": " "}}))
    got = {r.artifact_id: (r.code, r.actual) for r in manifest.artifact_failures(spark, str(path)).collect()}
    assert got == {"b": ("ARTIFACT_SHA256_MISMATCH", hashlib.sha256(b"another").hexdigest()), "c": ("ARTIFACT_FILE_UNREADABLE", None), "d": ("ARTIFACT_FILE_MAPPING_MISSING", None), "e": ("ARTIFACT_FILE_UNREADABLE", None)}
    path.write_text(json.dumps([1]))
    assert manifest.artifact_failures(spark, str(path)).collect() == [] and not manifest.registerable(spark, str(path))[0]


def test_registerable(spark, tmp_path):
    roles = [("movement_truth", "training"), ("movement_truth", "held_out_validation"), ("exposure_geometry_truth", "held_out_validation"), ("target_panel_truth", "held_out_validation"), ("downstream_validation_result", "held_out_validation")]
    artifacts = [artifact(f"a{k}", f"data {k}".encode(), kind, usage) for k, (kind, usage) in enumerate(roles)]
    for k in range(len(roles)):
        (tmp_path / f"a{k}").write_bytes(f"data {k}".encode())
    path = tmp_path / "m.json"

    def told(artifacts, files):
        path.write_text(json.dumps({"package": {"packageId": "p", "frozenAt": "2026-03-01T00:00:00Z", "artifacts": artifacts}, "artifactFiles": files}))
        return manifest.registerable(spark, str(path))

    files = {f"a{k}": f"a{k}" for k in range(len(roles))}
    fine, failures = told(artifacts, files)
    assert fine or all(not f.startswith("ARTIFACT") for f in failures)
    ok, failures = told(artifacts[:1], files)
    assert not ok and failures
    if fine:
        assert told(artifacts, files | {"a2": "a1"}) == (False, ["ARTIFACT_SHA256_MISMATCH:a2"])


def test_workbook_structure(spark):
    headers = ["consent", "city", 'say "é"']
    digest = hashlib.sha256('["consent","city","say \\"é\\""]'.encode()).hexdigest()
    assert survey.header_digest(headers) == digest
    rows = spark.createDataFrame([("S", 1, headers), ("S", 2, ["Yes", "Lagos", None]), ("S", 3, [None, " ", ""]), ("S", 4, ["No", None, "x"]), ("T", 1, ["other"])], "sheet string, row int, cells array<string>")
    wanted = survey.Workbook("s", "ab", "S", 2, 3, digest)
    assert survey.structure_failures(rows, "ab", wanted) == []
    assert survey.structure_failures(rows, "ac", wanted) == ["SOURCE_SHA256_MISMATCH"]
    assert survey.structure_failures(rows.where("sheet = 'T'"), "ab", wanted) == ["SHEET_NAME_MISMATCH", "COLUMN_COUNT_MISMATCH", "HEADER_SHA256_MISMATCH", "DATA_ROW_COUNT_MISMATCH"]
    assert survey.structure_failures(rows, "x") == ["SOURCE_SHA256_MISMATCH", "SHEET_NAME_MISMATCH", "COLUMN_COUNT_MISMATCH", "HEADER_SHA256_MISMATCH", "DATA_ROW_COUNT_MISMATCH"]


def test_publication(spark, tmp_path):
    people = [("Lagos", "18-24" if k % 2 else "25-34", True) for k in range(70)] + [("Abuja", "18-24", True)] * 10 + [("Lagos", None, True)] * 3 + [("Lagos", "18-24", False)] * 50
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/store"
    spark.createDataFrame(people, "city string, age_band string, eligible boolean").write.parquet(source)
    run = publish.publish(spark, "snapshot", source, folder, ["city", "age_band"], 30)
    store = RunStore(spark, folder)
    assert {r.scope: r.n for r in store.read(run, "snapshot", "facets").collect()} == {"overall": 83, "city=Lagos": 73, "age_band=18-24": 45, "age_band=25-34": 35, "city=Lagos|age_band=18-24": 35, "city=Lagos|age_band=25-34": 35}
    assert publish.publish(spark, "snapshot", source, folder, ["city", "age_band"], 30) == run and store.commits() == [run]
    other = publish.publish(spark, "catalogue", source, folder, ["age_band"], 30, "Lagos")
    assert sorted((r.value, r.sample_size) for r in store.read(other, "catalogue", "segments").collect()) == [("18-24", 35), ("25-34", 35)] and store.commits() == [run, other]
    with pytest.raises(ValueError, match="DIMENSION_UNKNOWN: colour"):
        publish.publish(spark, "snapshot", source, folder, ["colour"])
    with pytest.raises(ValueError, match="CITY_REQUIRED"):
        publish.publish(spark, "catalogue", source, folder, ["age_band"])
