"""Operators on literal fixtures."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import geo
from marquee.operators import heads, parse, raster, relational, spatial, store, survey
from marquee.sources import files
from marquee.streaming import windows


def test_percentiles_ignore_nulls(spark):
    rows = spark.createDataFrame([("a", v) for v in (100.0, 200.0, 300.0, 400.0, None)] + [("b", None)], "k string, v double")
    got = {r.k: r for r in relational.percentile_summary(rows, ["k"], "v").collect()}
    assert (got["a"].n_rows, got["a"].n_rated, got["a"].lo, got["a"].p25, got["a"].p50, got["a"].p75, got["a"].hi) == (5, 4, 100, 175, 250, 325, 400)
    assert (got["b"].n_rows, got["b"].n_rated, got["b"].p50) == (1, 0, None)


def test_radius_literals(spark):
    """Counts of five places and four roads around one site."""
    site = spark.createDataFrame([("s", 3.35, 6.6)], "site_id string, lon double, lat double")
    places = spark.createDataFrame([(k, x, 6.6) for k, x in enumerate((3.3505, 3.3530, 3.3560, 3.3580, 3.3650))], "id int, to_lon double, to_lat double")
    pairs = spatial.within(site, places, 1000.0)
    got = spatial.radius_summary(site, pairs, [250, 500, 1000], "site_id", {"n": F.count(F.lit(1))}).collect()
    assert {r.radius: r.n for r in got} == {250: 1, 500: 2, 1000: 4}
    classes = ("residential", "primary", "secondary", "tertiary")
    roads = spark.createDataFrame([(f"r{k}", c, [2 * k, 2 * k + 1], [(x, 6.595), (x, 6.605)]) for k, (c, x) in enumerate(zip(classes, (3.3505, 3.3535, 3.3580, 3.3650)))], "road_id string, road_class string, connectors array<int>, path array<struct<lon:double,lat:double>>")
    net = {r.radius: r for r in spatial.network_context(site, roads, [250, 500, 1000]).collect()}
    assert [(net[r].n_roads, net[r].n_major, net[r].n_connectors) for r in (250, 500, 1000)] == [(1, 0, 2), (2, 1, 4), (3, 2, 6)]
    assert net[250].nearest_road == "r0" and net[250].nearest_major is None and net[500].nearest_major == "r1"
    assert net[250].length_m == pytest.approx(2 * (250**2 - net[250].nearest_road_m ** 2) ** 0.5, rel=1e-9)


def test_empty_radius_gives_zero_and_uncovered_gives_nothing(spark):
    site = spark.createDataFrame([("s", 3.35, 6.6)], "site_id string, lon double, lat double")
    none = spatial.within(site, spark.createDataFrame([(9.0, 9.0)], "to_lon double, to_lat double"), 1000.0)
    covered = geo.box_covers(F.col("lon"), F.col("lat"), F.col("radius").cast("double"), 3.345, 6.59, 3.36, 6.61)
    got = spatial.radius_summary(site, none, [250, 1000], "site_id", {"n": F.count(F.lit(1))}, covered).collect()
    assert [(r.radius, r.n) for r in got] == [(250, 0)]


def test_population_within(spark):
    site = spark.createDataFrame([("s", 3.35, 6.6)], "site_id string, lon double, lat double")
    cells = spark.createDataFrame([(3.35, 6.6, 2.0), (3.351, 6.6, None), (3.352, 6.6, 5.0), (3.4, 6.6, 9.0)], "lon double, lat double, value double")
    got = {r.radius: (r.population, r.n_valid, r.n_nodata) for r in spatial.population_within(site, cells, [50, 500]).collect()}
    assert got == {50: (2.0, 1, 0), 500: (7.0, 2, 1)}


def test_cost_surface():
    even = raster.cost_surface(np.full((9, 9), 0.01), (4, 4), 1e9, 100.0, 100.0)
    assert even[4, 8] == pytest.approx(4.0) and even[8, 8] == pytest.approx(4 * 2**0.5) and even[4, 4] == 0
    rng = np.random.default_rng(0)
    friction = rng.uniform(0.01, 0.2, (9, 9))
    friction[2, 3:6] = np.nan
    cost = raster.cost_surface(friction, (4, 4), 1e9, 30.0, 40.0)
    want = np.full((9, 9), np.inf)
    want[4, 4] = 0
    for _ in range(81):  # Bellman-Ford
        for r in range(9):
            for c in range(9):
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        if (a or b) and 0 <= r + a < 9 and 0 <= c + b < 9 and np.isfinite(friction[r, c]) and np.isfinite(friction[r + a, c + b]):
                            step = math.hypot(40.0 * a, 30.0 * b) * (friction[r, c] + friction[r + a, c + b]) / 2
                            want[r, c] = min(want[r, c], want[r + a, c + b] + step)
    assert np.allclose(cost, want)


def test_placement_rows(spark):
    row = ["1", "Acme", "SW", "Lagos", "Ikeja", "1 Road", "Brand", "Beer", "Billboard", "Static", "A", "1,200,000", "abc", "2021", "Q2", "April"]
    table = [("s", "x", 1, row), ("s", "x", 2, [None] * 16), ("s", "x", 3, [*row[:13], "21", "1", "May"]), ("s", "x", 4, ["2", None, *row[2:]]), ("s", "x", 5, [*row[:13], "2020", "7", "June/July"])]
    good, bad = parse.placement_rows(spark.createDataFrame(table, "source string, sheet string, row int, cells array<string>"), superseded_years=(2020,))
    got = {r.row: r for r in good.collect()}
    assert set(got) == {1, 5} and got[1].annual_rate == 1_200_000 and got[1].flags == ["monthly_rate_unparsed"] and got[1].period.months == [4]
    assert got[5].canonical_status == "superseded" and got[5].flags == ["monthly_rate_unparsed", "quarter_invalid"] and got[5].period.kind == "combined"
    assert {r.row: r.reason for r in bad.collect()} == {3: "invalid_year", 4: "invalid_row_shape"}


def test_inventory(spark):
    rows = [(1, "A1", "1 Road", 6.5, 3.3, None, 5.0), (2, "a1 ", "2 Road", None, None, None, 5.0), (3, "B", "3 Road", None, None, "Ada", 5.0), (4, None, "x", 95.0, 3.0, None, -1.0), (5, "C", "mail me@x.org", None, None, None, None)]
    got = parse.validate_inventory(spark.createDataFrame(rows, "row int, asset_id string, address string, latitude double, longitude double, person_name string, rate double"))
    assert {r.row: (r.status, r.reasons) for r in got.collect()} == {
        1: ("accepted", []), 2: ("rejected", ["DUPLICATE_ASSET_ID"]), 3: ("quarantined", ["PERSON_NAME"]), 4: ("rejected", ["ASSET_ID_MISSING", "COORDINATE_INVALID", "RATE_INVALID"]), 5: ("quarantined", ["EMAIL"])
    }


def test_headers():
    got = parse.map_headers(["Billboard ID", "Site location address", "Owner", "Mystery"])
    assert got["Billboard ID"] == ("asset_id", 1.0, True) and got["Owner"][0] == "supplier"
    assert got["Site location address"][0] == "address" and not got["Site location address"][2] and "Mystery" not in got


def test_sites_and_airports(spark):
    rows = spark.createDataFrame([(1, "Lagos", "Ikeja", "1 Rd", "Static", "UNI-POLE."), (2, " lagos", "IKEJA", "1 rd.", "static", " uni pole "), (3, "Lagos", "Ikeja", None, "Static", "Wall")], "id int, state string, city string, address string, format string, board_type string")
    good, review = parse.site_entities(rows)
    assert len({r.site_id for r in good.collect()}) == 1 and [r.id for r in review.collect()] == [3]
    one = parse.representative_sites(good, [F.col("id")]).first()
    assert (one.id, one.board_type, one.n_rows) == (1, "UNI-POLE.", 2)
    names = spark.createDataFrame([("Murtala Muhammed", "Lagos"), ("LOS", "Lagos"), ("Other", "Lagos"), ("Some", "Abuja")], "label string, state string")
    aliases = spark.createDataFrame([("murtala muhammed", "LOS", 0), ("los", "LOS", 1)], "key string, airport string, rank int")
    anchors = relational.unique_anchor(spark.createDataFrame([("Lagos", "LOS"), ("Abuja", "ABV"), ("Abuja", "XXX")], "state string, airport string"), "state", "airport")
    assert {r.label: (r.airport, r.method) for r in parse.airport_links(names, aliases, anchors).collect()} == {"Murtala Muhammed": ("LOS", "exact_name"), "LOS": ("LOS", "alias"), "Other": ("LOS", "state_anchor"), "Some": (None, "review")}


def test_survey_suppression(spark):
    rows = spark.createDataFrame([("High", 1.0, True)] * 12 + [("Low", 3.0, False)] * 4 + [(None, 5.0, True)] * 2, "level string, rating double, seen boolean")
    got = {(r.scope, r.metric): r for r in survey.cube(rows, [[], ["level"]], {"seen": (F.lit(True), F.col("seen").cast("int")), "rated": (F.col("rating") > 1, F.col("rating"))}, minimum=10).collect()}
    assert {s for s, _ in got} == {"overall", "level=High"}
    assert got["overall", "seen"].value == pytest.approx(14 / 18, abs=1e-6) and got["level=High", "seen"].value == 1.0
    assert got["overall", "rated"].value is None and got["overall", "rated"].suppressed
    order = [r.scope for r in survey.most_specific(survey.cube(rows, [[], ["level"]], {"seen": (F.lit(True), F.col("seen").cast("int"))}, minimum=10)).collect()]
    assert order == ["level=High", "overall"]


def test_rating_matrix(spark):
    rows = spark.createDataFrame([([("a", "x", 1.0), ("a", "y", 3.0)],), ([("a", "x", 5.0), ("a", "y", None)],)], "r array<struct<row:string,column:string,rating:double>>")
    got = {(x.row, x.column): (x.n, x["mean"]) for x in survey.rating_matrix(rows, "r", 1).collect()}
    assert got == {("a", "x"): (2, 3.0), ("a", "y"): (1, 3.0), ("all", "all"): (1, 2.0)}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "a", 9), (2, "b", 2), (3, "c", 3)], "k int, v string, t int")
    assert [r.k for r in store.append_new(new, old, ["k"]).collect()] == [3]
    assert [r.k for r in store.drift(old, new, ["k"], ignore=("t",)).collect()] == [2]
    assert {(r.k, r.v, r.t) for r in store.upsert(old, new, ["k"], ["v"], ["t"]).collect()} == {(1, "a", 9), (2, "b", 2), (3, "c", 3)}
    rules = {"POSITIVE": F.col("t") > 1, "KNOWN": F.col("v").isNotNull()}
    assert {r.k: r.violations for r in store.violations(old, ["k"], rules).collect()} == {1: ["POSITIVE"], 2: ["KNOWN"]}
    assert store.write_snapshot(old, str(tmp_path), "s1") and not store.write_snapshot(old, str(tmp_path), "s1")
    with pytest.raises(ValueError, match="SNAPSHOT_IMMUTABLE"):
        store.write_snapshot(new, str(tmp_path), "s1")


def test_coherent_head(spark):
    snaps = spark.createDataFrame([("s", 1, "2024-01-01"), ("s", 2, "2024-02-01")], "site string, snapshot_id int, at string")
    rows = spark.createDataFrame([("s", 1, 250), ("s", 1, 500), ("s", 2, 250)], "site string, snapshot_id int, radius int")
    assert [(r.snapshot_id, r.radius) for r in heads.coherent_head(snaps, rows, ["site"], [F.desc("at")]).collect()] == [(2, 250)]


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><f>1+1</f><v>2</v></c><c r="AA3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_sources(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    got = [(r.sheet, r.row, r.cells) for r in files.read_workbooks(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()]
    assert got[0] == ("One", 1, ["name", None, "rich"]) and got[1][1] == 3 and got[1][2][1] == "2" and got[1][2][26] == "x"
    (tmp_path / "a.tsv").write_text("id\tname\n1\ta b\n")
    assert files.read_delimited(spark, str(tmp_path / "a.tsv")).collect()[0].asDict() == {"id": "1", "name": "a b"}
    with pytest.raises(ValueError):
        files.read_delimited(spark, "x.xls")
    (tmp_path / "a.ndjson").write_text('{"k": 1}\nnot json\n')
    good, bad = files.quarantine_ndjson(spark, str(tmp_path / "a.ndjson"), "k int")
    assert [r.k for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        files.read_ndjson(spark, str(tmp_path / "a.ndjson"), "k int").collect()
    feature = '{"type":"Feature","id":"%s","properties":{"n":"v"},"geometry":{"type":"Point","coordinates":[3.3,6.5]}}'
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[%s,%s]}' % (feature % "a", feature % "b"))
    (tmp_path / "s.geojsonseq").write_text("\x1e" + feature % "a" + "\n\x1e" + feature % "b" + "\n")
    for got in (files.read_geojson(spark, str(tmp_path / "c.geojson")), files.read_geojson_sequence(spark, str(tmp_path / "s.geojsonseq"))):
        assert sorted((r.id, r.properties["n"], r.geometry.coordinates) for r in got.collect()) == [("a", "v", "[3.3,6.5]"), ("b", "v", "[3.3,6.5]")]
    (tmp_path / "airports.csv").write_text("id,iso_country\n1,NG\n2,GH\n")
    assert files.read_airports(spark, str(tmp_path / "airports.csv")).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.stream_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    order = ["window_start", "event_type"]
    assert spark.table("counts").orderBy(*order).collect() == windows.window_counts(events).orderBy(*order).collect()
