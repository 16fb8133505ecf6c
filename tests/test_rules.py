"""Rule, source and plan-change operators on small cases; the queries over whole tables are held against SQL elsewhere."""

import datetime
import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marquee.operators import adjust, assertions, briefs, checks, delivery, evidence, parse, policies, runs, survey, uploads
from marquee.plans import planner
from marquee.sources import registry


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_brief_narrows_the_bundle(spark):
    cells = F.array(*[F.lit(c) for s, c, _, _ in briefs.AUDIENCES if s == "fmcg"])
    a = one(spark, a=briefs.resolve_audience(F.lit("fmcg"), [F.lit("University freshers"), F.lit(None).cast("string")], cells)).a
    assert (a.mode, a.cell_ids, a.signals) == ("focused", ["student_buyers_18_24"], ["university"])
    bundle = briefs.narrowed(planner.demo_bundle(spark), "fmcg", a.cell_ids)
    assert {r.cell_id for r in bundle.panel.where("sector = 'fmcg'").select("cell_id").distinct().collect()} == {"student_buyers_18_24"}
    assert bundle.panel.where("sector = 'real_estate'").select("cell_id").distinct().count() == 3


def test_bundle_failures(spark):
    bundle = planner.demo_bundle(spark)
    targets = bundle.panel.groupBy("sector", "cell_id").agg(F.sum("weight").alias("universe"))
    assert checks.bundle_failures(bundle, targets).count() == 0
    low = F.when(F.col("scenario") == "low", 2.0).otherwise(F.col("movement_mult"))
    wrong = replace(bundle, scenarios=bundle.scenarios.withColumn("movement_mult", low), panel=bundle.panel.union(bundle.panel.limit(1)), shares=bundle.shares.where("NOT (site_id = 'vi-face-1' AND cell_ord = 0 AND sector = 'fmcg')"))
    found = {r.code for r in checks.bundle_failures(wrong, targets).collect()}
    assert found == {"SCENARIO_NOT_MONOTONE", "DUPLICATE_MEMBER", "PANEL_WEIGHT_NOT_UNIVERSE", "SHARE_PARTITION_MISMATCH"}


def test_guards_and_sources(spark):
    assert checks.snapshot_guards(("a", "a"), ((1,), (1,)), 3, 1, 2, "2026-01-02", "2026-01-01") == []
    assert checks.snapshot_guards(("a", "b"), ((1,), (2,)), 0, 2, 0, None, "2026") == ["RELEASE_MISMATCH", "BOUNDS_MISMATCH", "NO_ELIGIBLE_COORDINATES", "BASIS_ROW_REQUIRED", "EMPTY_MANIFEST", "RESOLUTION_OLDER_THAN_SOURCE"]
    rows = [("a", "r", "1", "cc", "permitted", "g"), ("b", "x", "1", "cc", "permitted", "g"), ("c", "r", "2", "cc", "permitted", "g"), ("d", "r", "1", " ", "permitted", "g"), ("e", "r", "1", "cc", "no", "g"), ("f", "r", "1", "cc", "permitted", None)]
    frame = spark.createDataFrame(rows, "source_id string, role string, version string, license_id string, commercial_use string, grid_signature string")
    assert [r.reason for r in checks.eligible_sources(frame, "r", "1", "g").orderBy("source_id").collect()] == [None, "ROLE", "VERSION", "LICENSE", "RIGHTS", "GRID_SIGNATURE"]
    lost = checks.without_lineage(spark.createDataFrame([("x",), ("y",)], "artifact_id string"), spark.createDataFrame([("y", "p")], "child_id string, parent_id string"))
    assert [r[0] for r in lost.collect()] == ["x"]
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s")], "k int, v string, status string")
    new = spark.createDataFrame([(1, "z", "s"), (2, "b", "t"), (3, "z", "s")], "k int, v string, status string")
    assert [r.k for r in checks.changed_evidence(old, new, "k", ("status",), [spark.createDataFrame([(1,), (2,)], "k int")]).collect()] == [1]


def test_feature_used_once(spark):
    uses = spark.createDataFrame([("a", "score", "A"), ("a", "score", "A"), ("b", "score", "A"), ("b", "score", "D"), ("c", "measurement", None), ("c", "score", "P"), ("d", "measurement", None)], "feature_id string, role string, pillar string")
    assert sorted(r.feature_id for r in evidence.used_twice(uses).collect()) == ["b", "c"]


def test_periods(spark):
    day = lambda a, b: one(spark, x=evidence.period_valid(F.lit(a), F.lit(b))).x
    assert day("2024-02-29", "2024-03-01") and not day("2023-02-29", "2023-03-01") and not day("2024-03-02", "2024-03-01") and not day("2024-3-1", "2024-03-02")


def test_upload_lifecycle(spark):
    rows = spark.createDataFrame([("a", "x", None, None, "new"), ("b", "y", None, None, "new"), ("c", "z", 3.0, 6.0, "confirmed"), ("d", "w", None, None, "new")], "row_id string, address string, lon double, lat double, status string")
    answers = spark.createDataFrame([("a", 0.5, 1.0, 1.0, "p", False), ("a", 0.9, 2.0, 2.0, "q", False), ("b", None, None, None, "p", True), ("c", 1.0, 9.0, 9.0, "p", False)], "row_id string, confidence double, lon double, lat double, provider string, failed boolean")
    merged = uploads.merged_answers(rows, answers)
    assert [(r.row_id, r.lon, r.status, r.provider) for r in merged.orderBy("row_id").collect()] == [("a", 2.0, "proposed", "q"), ("b", None, "failed", None), ("c", 3.0, "confirmed", None), ("d", None, "new", None)]
    done = uploads.decided(merged, spark.createDataFrame([("a", "confirm", None, None), ("b", "correct", 4.0, 5.0), ("d", "confirm", None, None)], "row_id string, action string, lon double, lat double"))
    assert sorted((r.row_id, r.lon, r.status) for r in uploads.applied(done).collect()) == [("a", 2.0, "confirmed"), ("b", 4.0, "corrected"), ("c", 3.0, "confirmed")]
    known = rows.select("row_id")
    reason = lambda ids: uploads.selection_failure(spark.createDataFrame([(i,) for i in ids], "row_id string"), known).first().reason
    assert (reason(["a"]), reason([]), reason(["a", "q"]), reason([str(i) for i in range(51)])) == (None, "NO_ROWS_SELECTED", "UNKNOWN_ROWS", "TOO_MANY_ROWS")
    assert [one(spark, x=uploads.format_name(F.lit(x))).x for x in ("Digital 48", "STATIC wall", " ", "Gantry")] == ["dooh", "static", None, "gantry"]


def test_open_map_features(spark):
    place = lambda text, lon=3.0: one(spark, r=policies.place(F.lit(text), F.lit(lon), F.lit(6.0))[1]).r
    good = '{"id":"p","version":1,"confidence":0.5,"sources":[{"dataset":"d","license":"cc"}]}'
    assert place(good) is None and place(good, 190.0) == "PLACE_COORDINATE_INVALID" and place(good.replace('"p"', '" "')) == "FEATURE_ID_REQUIRED" and place(good.replace("0.5", "1.5")) == "PLACE_CONFIDENCE_INVALID"
    assert place(good.replace(":1,", ":1.5,")) == "FEATURE_VERSION_INVALID" and place('{"id":"p","version":1,"sources":[]}') == "SOURCES_REQUIRED" and place(good.replace('"d"', '" "')) == "SOURCE_DATASET_REQUIRED"
    line = F.array(F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(3.1), F.lit(6.0)))
    road = lambda text, l=line: one(spark, r=policies.road(F.lit(text), l)[1]).r
    assert road('{"id":"r","class":"Primary"}') is None and road('{"id":"r","class":"canal"}') == "ROAD_CLASS_INVALID" and road('{"id":"r"}', F.array(F.array(F.lit(3.0), F.lit(6.0)))) == "ROAD_LINESTRING_TOO_SHORT"
    kind = lambda a, m: one(spark, x=policies.advertising_type(F.lit(a).cast("string"), F.lit(m).cast("string"))).x
    assert (kind("Billboard", None), kind("flag", None), kind(None, "advertising")) == ("billboard", None, "advertising")
    p = one(spark, x=policies.representative_point(line, F.lit(False))).x
    assert (p.lon, p.lat, p.method) == (pytest.approx(3.05), 6.0, "vertex_mean")


def test_survey_answers(spark):
    yes = lambda t: one(spark, x=survey.yes_no(F.lit(t).cast("string"))).x
    assert [yes(t) for t in ("Yes", "yes → next", "NO ", "nobody", None)] == [True, True, False, None, None]
    names = "source_row int, consent string, residence string, city string, age_band string, latitude string, longitude string, gps_precision string, started string, ended string, commute string, m1 string, m2 string, r1 string"
    rows = [(1, "yes", "Yes", " Lagos ", "18-25", "6.5", "3.4", "4", "2026-01-01 10:00:00", "2026-01-01 10:30:00", "daily  commuter", "1", "0", "4"), (2, "yes", "no", "Lagos", "56+", "60", "3", "0", "2026-01-01 10:00:00", "2026-01-01 09:00:00", "Walks", "true", "YES", "x")]
    got = survey.canonical_responses(spark.createDataFrame(rows, names), {"formats": (("m1", "LED"), ("m2", "Static"))}, {"formats": (1, "FORMAT_COUNT")}, (("led", "trust", "r1"),)).orderBy("source_row").collect()
    assert (got[0].eligible, got[0].city, got[0].commute_pattern, got[0].formats, got[0].diagnostics, got[0].ratings[0].rating, got[0].started) == (True, "Lagos", "Daily commuter", ["LED"], [], 4.0, "2026-01-01T10:00:00.000Z")
    assert got[1].diagnostics == ["CONTEXT_SCREEN_NOT_ELIGIBLE", "GPS_OUTSIDE_NIGERIA_BOUNDS", "GPS_PRECISION_NONPOSITIVE", "INTERVIEW_DURATION_NEGATIVE", "FORMAT_COUNT"] and got[1].ratings[0].rating is None
    facets = spark.createDataFrame([("overall", 90), ("city=Lagos", 60), ("age=18|city=Lagos", 31), ("age=26|city=Lagos", 40)], "scope string, n int")
    pick = lambda w: survey.select_facet(facets, w).first().scope
    assert (pick({}), pick({"city": "Lagos"}), pick({"age": "18", "city": "Lagos"}), pick({"age": "26"})) == ("overall", "city=Lagos", "age=18|city=Lagos", "overall")


def test_owners_and_decisions(spark):
    rows = spark.createDataFrame([("s1", "  Big  Media Ltd.", "n", "src", "r", "approved"), ("s2", "!!", "n", "src", "r", "approved")], "site_id string, owner_name string, namespace string, source_id string, revision string, status string")
    good, bad = assertions.owner_assertions(rows)
    r = good.first()
    assert (r.canonical_name, r.owner_key) == ("Big Media Ltd.", "big media ltd") and r.owner_id.startswith("owner:") and bad.first().reason == "MEDIA_OWNER_NORMALIZED_KEY_REQUIRED"
    old = spark.createDataFrame([("o1", "First")], "owner_id string, canonical_name string")
    new = spark.createDataFrame([("o1", "Later"), ("o2", "b"), ("o2", "a")], "owner_id string, canonical_name string")
    assert sorted(map(tuple, assertions.stable_owners(old, new).collect())) == [("o1", "First"), ("o2", "a")]
    reason = one(spark, a=assertions.decision_failure(F.lit("confirmed"), F.lit("guess"), F.lit("s"), F.lit("r")), b=assertions.decision_failure(F.lit("rejected"), F.lit("manual_review"), F.lit("s"), F.lit("r")))
    assert (reason.a, reason.b) == ("DECISION_METHOD_INVALID", None)


def test_zone_swaps(spark):
    bundle, brief = planner.demo_bundle(spark), planner.BRIEFS[0]
    plan = spark.createDataFrame([("p", ["yaba-face-1", "ikeja-face-1", "vi-face-1"])], "plan_id string, sites array<string>")
    swaps = adjust.zone_swaps(bundle.sites, plan, planner.flight_compatible(brief.flight_start, brief.flight_end)).cache()
    assert swaps.count() == 3 * 4 and swaps.where("dropped = target").count() == 0
    measured = planner.candidates(bundle, brief, swaps.select("package_id", "sites").dropDuplicates(["package_id"])).where("extra")
    best = {r.dropped: r for r in adjust.replacements(swaps, measured, ["plan_id", "dropped"]).collect()}
    fits = {r.package_id: (r.valid, r.fit) for r in measured.collect()}
    for dropped in ("yaba", "ikeja", "vi"):
        mine = [fits[r.package_id] for r in swaps.where(F.col("dropped") == dropped).collect()]
        assert (best[dropped].valid, best[dropped].fit) == max(mine)
    named = adjust.replacements(swaps, measured, ["plan_id", "dropped", "target"])
    assert named.count() == 6
    swaps.unpersist()


def test_stale_requests(spark):
    t, f = F.lit(True), F.lit(False)
    sites = F.array(F.lit("a"), F.lit("b"))
    r = one(spark, ok=adjust.request_staleness(t, t, t, F.lit("x"), F.lit("x"), sites, F.array(F.lit("b"), F.lit("a"))), stale=adjust.request_staleness(t, t, t, F.lit("x"), F.lit("y"), sites, sites), bad=adjust.request_staleness(f, t, t, F.lit("x"), F.lit("x"), sites, sites), s=adjust.share_range(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(10.0)))
    assert (r.ok, r.stale, r.bad, r.s.base) == (None, "STALE_APPLIED_PLAN", "PACKAGE_INVALID", 20.0)


def test_keys_and_source_ids(spark):
    r = one(spark, k=delivery.comparability_key({"b": F.lit(None).cast("string"), "a": F.array(F.lit("x"))}), s=delivery.source_ids(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit(None).cast("string"))))
    assert (r.k, r.s) == ('{"a":["x"],"b":null}', ["a", "b"])


def test_sheet_rows(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, [" ", None]), (3, [None, "b"])], "source_row int, cells array<string>")
    assert parse.expect_rows(rows, 2).count() == 3
    with pytest.raises(Exception, match="SOURCE_ROW_COUNT_MISMATCH:2"):
        parse.expect_rows(rows, 3).collect()
    traffic = spark.createDataFrame([("passenger", None, "kg", "active"), ("cargo", "intl", " ", "active"), ("mail", "x", "kg", "superseded")], "metric string, scope string, unit string, canonical_status string")
    assert [(r.scope_key, r.unit_key) for r in parse.traffic_keys(parse.active(traffic)).collect()] == [("unscoped", "persons"), ("intl", "source_unit_unspecified")]


def test_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n")
    (tmp_path / "b.csv").write_bytes(b"z\n")
    sha = hashlib.sha256(b"x,y\n").hexdigest()
    specs = (registry.SourceSpec("a", "a.csv", sha), registry.SourceSpec("b", "b.csv", sha), registry.SourceSpec("c", "c.csv", sha))
    assert [r.status for r in registry.verified(spark, str(tmp_path), specs).orderBy("source_id").collect()] == ["ok", "changed", "missing"]
    registry.require_verified(spark, str(tmp_path), specs[:1])
    with pytest.raises(ValueError, match="SOURCE_CHECKSUM_CHANGED:b"):
        registry.require_verified(spark, str(tmp_path), specs)
    source = registry.OpenSource("s", "p", "cc", "download")
    assert registry.artifact(source, sha, 4, "r", "2026-01-01")["artifact_id"] == registry.artifact(source, sha, 4, "r", "2026-01-01")["artifact_id"]
    for wrong, args, code in ((replace(source, license_id=" "), (sha, 4), "LICENSE"), (replace(source, enabled=False), (sha, 4), "DISABLED"), (source, ("x", 4), "SHA256"), (source, (sha, 0), "EMPTY")):
        with pytest.raises(ValueError, match=code):
            registry.artifact(wrong, *args, "r", "2026-01-01")
    assert registry.source_table(spark, (source,)).count() == 1
    with pytest.raises(ValueError, match="DUPLICATE"):
        registry.source_table(spark, (source, source))


def test_copy_text_and_swaps(spark, tmp_path):
    frame = spark.createDataFrame([("a\tb\\c\nd", None, 1.5, [1]), (None, datetime.date(2026, 1, 2), None, None)], "t string, d date, x double, a array<int>")
    path = str(tmp_path / "copy")
    registry.write_copy(frame.coalesce(1), path)
    assert sorted(spark.read.text(path).toPandas()["value"]) == ["\\N\t2026-01-02\t\\N\t\\N", "a\\tb\\\\c\\nd\t\\N\t1.5\t[1]"]
    with pytest.raises(Exception, match="NON_FINITE_NUMBER:x"):
        frame.select((F.lit(1e308) * 10).alias("x")).transform(lambda d: d.select(registry.copy_text(d))).collect()
    target = str(tmp_path / "table")
    registry.swap_folder(frame, target)
    registry.swap_folder(frame.limit(1), target)
    assert spark.read.parquet(target).count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["copy", "table"]
    assert frame.select(registry.canonical_rows(frame).alias("j")).orderBy(F.desc("j")).first().j == '{"a":null,"d":"2026-01-02","t":null,"x":null}'


def test_runs_and_field_maps(spark):
    rows = [("a", "succeeded", 3), ("b", "succeeded", 5), ("c", "succeeded", 5), ("d", "failed", 9), ("e", "succeeded", None)]
    assert runs.latest_run(spark.createDataFrame(rows, "run_id string, status string, completed_at int")).first().run_id == "c"
    assert runs.field_map({"building_count": " n ", "place_code": None}) == {"feature_id": "$fid", "building_count": "n"}
    for wrong, code in (({"x": "y"}, "KEY_INVALID"), ({"place_code": " "}, "VALUE_REQUIRED"), ({"place_code": "n", "building_count": "n"}, "DUPLICATE")):
        with pytest.raises(ValueError, match=code):
            runs.field_map(wrong)
    frame = spark.createDataFrame([("7", "q")], "n string, other string")
    r = runs.mapped_fields(frame, runs.field_map({"building_count": "n"}), F.lit("row-1")).first()
    assert (r.feature_id, r.building_count, r.place_code) == ("row-1", "7", None)
    assert runs.without_absent({"a": ..., "b": [1, ..., {"c": ...}]}) == {"b": [1, None, {}]} and runs.digest({"b": 1, "a": 2}) == runs.digest({"a": 2, "b": 1})
    lock = spark.createDataFrame([("t", "1")], "table string, revision string")
    assert runs.pinned(spark.createDataFrame([("t", "1"), ("t", "2")], "table string, revision string"), lock).first().revision == "2"
    facts = spark.createDataFrame([("x", None), ("x", "e")], "a_entity_id string, b_entity_id string")
    assert [tuple(r) for r in runs.unmapped(facts, ("a", "b")).collect()] == [("b", 1)]


def test_context_artifact_must_be_of_the_same_snapshot(spark):
    art = lambda d, u="context_only": F.struct(F.lit(d).alias("snapshot_digest"), F.lit(u).alias("decision_use"))
    artifacts = F.create_map(F.lit("p"), art("d1"), F.lit("q"), art("d2"), F.lit("r"), art("d1", "any"))
    got = [one(spark, x=runs.resolved_artifact(F.lit(p).cast("string"), artifacts, art("d1"))).x for p in ("p", "q", "r", None)]
    assert [x.failure for x in got] == [None, "SURVEY_SEGMENT_SOURCE_SNAPSHOT_MISMATCH", "SURVEY_SEGMENT_DECISION_USE_INVALID", None] and got[3].artifact.snapshot_digest == "d1"


def test_radii_and_latitudes(spark):
    from marquee.functions import geo

    assert geo.context_radii("vector", [500, 250, 500]) == [250, 500]
    for family, values in (("vector", []), ("vector", [6000]), ("vector", range(1, 9)), ("settlement", [10])):
        with pytest.raises(ValueError, match="RADII_INVALID"):
            geo.context_radii(family, list(values))
    with pytest.raises(Exception, match="LATITUDE_BEYOND_CELLS"):
        geo.up_to_latitude(spark.createDataFrame([(20.0,)], "lat double"), "lat", 15.0).collect()


def test_polygons(spark, tmp_path):
    from marquee.operators import polygons

    ring = lambda *c: [{"lon": x, "lat": y} for x, y in c]
    shape = [ring((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01)), ring((0.004, 0.004), (0.006, 0.004), (0.006, 0.006), (0.004, 0.006))]
    shapes = spark.createDataFrame([("p", shape)], "polygon_id string, rings array<array<struct<lon:double,lat:double>>>")
    cases = {"in": (0.002, 0.002), "edge": (0.01, 0.005), "corner": (0.0, 0.0), "hole": (0.005, 0.005), "rim": (0.004, 0.005), "out": (0.0101, 0.005), "far": (0.5, 0.5)}
    points = spark.createDataFrame([(n, *c) for n, c in cases.items()], "site_id string, lon double, lat double")
    assert sorted(r.site_id for r in polygons.containing(points, shapes).collect()) == ["corner", "edge", "in", "rim"]
    near = {r.site_id: r.distance for r in polygons.touching(points, shapes, 50.0).collect()}
    assert near["in"] == 0 and near["out"] == pytest.approx(11.13, abs=0.02) and near["far"] is None and near["hole"] is None
    assert {r.site_id: r.distance for r in polygons.touching(points, shapes, 200.0).collect()}["hole"] == pytest.approx(110.6, abs=0.5)
    path = str(tmp_path / "places")
    spark.createDataFrame([(i, {"xmin": i / 10, "ymin": 6.0, "xmax": i / 10, "ymax": 6.0}) for i in range(50)], "id int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>").write.parquet(path)
    found = polygons.read_places(spark, path, 1.0, 5.0, 2.0, 7.0)
    assert found.count() == 11 and "PushedFilters: [IsNotNull(bbox.xmin), IsNotNull(bbox.ymin), GreaterThanOrEqual(bbox.xmin,1.0)" in found._jdf.queryExecution().toString().replace("...", "")
    assert polygons.read_roads(spark, path, 1.0, 5.0, 2.0, 7.0).count() == 11
