"""GeoPackage files that the tests write, and repair of polygons."""

import json
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import repair
from marquee.sources import geopackage


def wkb(polygons, order="<", dims=2):
    code = {2: 0, 3: 1000}[dims]
    one = lambda rings: struct.pack(f"{order}BII", order == "<", 3 + code, len(rings)) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{dims}d", *p, *[0.0] * (dims - 2)) for p in r) for r in rings)
    return one(polygons[0]) if len(polygons) == 1 else struct.pack(f"{order}BII", order == "<", 6 + code, len(polygons)) + b"".join(map(one, polygons))


def blob(polygons, envelope=True, order="<", dims=2, srs=4326):
    xs, ys = ([p[k] for s in polygons for r in s for p in r] for k in (0, 1))
    return b"GP\x00" + bytes([1 | (2 if envelope else 0)]) + struct.pack("<i", srs) + (struct.pack("<4d", min(xs), max(xs), min(ys), max(ys)) if envelope else b"") + wkb(polygons, order, dims)


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


def write(path, features, srs=4326, tree=True, layers=("extents",)):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER PRIMARY KEY, organization_coordsys_id INTEGER)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?)", (srs, srs))
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER)")
    for name in layers:
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', 0, 0, 10, 10)", (name,))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?)", (name, srs))
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB, code TEXT(8), buildings INTEGER, density REAL, urban BOOLEAN)')
        if tree:
            db.execute(f'CREATE VIRTUAL TABLE "rtree_{name}_geom" USING rtree(id, minx, maxx, miny, maxy)')
        for fid, polygons, shape in features:
            db.execute(f'INSERT INTO "{name}" VALUES (?, ?, ?, ?, ?, ?)', (fid, shape, f"c{fid}", fid * 2, fid / 4, fid % 2))
            if tree and polygons:
                xs, ys = ([p[k] for s in polygons for r in s for p in r] for k in (0, 1))
                db.execute(f'INSERT INTO "rtree_{name}_geom" VALUES (?, ?, ?, ?, ?)', (fid, min(xs), max(xs), min(ys), max(ys)))
    db.commit()
    db.close()
    return str(path)


@pytest.fixture
def features():
    draw = random.Random(1)
    found = []
    for k in range(1, 241):
        x, y, h = draw.uniform(0, 10), draw.uniform(0, 10), draw.uniform(0.01, 0.2)
        polygons = [[square(x, y, h), square(x, y, h / 3)]] if k % 3 else [[square(x, y, h)], [square(x + 1, y, h)]]
        found.append((k * 5, polygons, blob(polygons, k % 2 == 0, "<" if k % 5 else ">", 3 if k % 7 == 0 else 2)))
    return [*found, (7, None, None)]


def test_read_and_pushed_box(spark, tmp_path, features):
    path = write(tmp_path / "a.gpkg", features)
    df = geopackage.read(spark, path, rows=100)
    assert df.columns == ["fid", "polygons", "xmin", "ymin", "xmax", "ymax", "code", "buildings", "density", "urban"] and df.rdd.getNumPartitions() == 12
    got = {r.fid: r for r in df.collect()}
    assert set(got) == {f[0] for f in features} and got[7].polygons is None and got[7].xmin is None
    for fid, polygons, _ in features[:-1]:
        r = got[fid]
        assert [[[(p.lon, p.lat) for p in ring] for ring in s] for s in r.polygons] == polygons
        assert (r.code, r.buildings, r.density, r.urban) == (f"c{fid}", fid * 2, fid / 4, bool(fid % 2))
    box = df.where("xmax >= 3 AND xmin <= 4.5 AND ymax >= 2 AND ymin <= 6 AND buildings > 20")
    want = {f for f, p, _ in features[:-1] if f * 2 > 20 and (r := got[f]).xmax >= 3 and r.xmin <= 4.5 and r.ymax >= 2 and r.ymin <= 6}
    assert {r.fid for r in box.collect()} == want and 5 < len(want) < 100


def test_the_tree_takes_the_box(tmp_path, features):
    """Rows that the tree leaves out are not decoded."""
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    path = write(tmp_path / "a.gpkg", features)
    db = geopackage.connect(path)
    reader = geopackage.Reader(path, geopackage.layer_of(db, None), 10_000)
    filters = [GreaterThanOrEqual(("xmax",), 3.0), LessThanOrEqual(("xmin",), 4.5), LessThanOrEqual(("xmax",), 9.0), GreaterThanOrEqual(("buildings",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    where, values = reader.where()
    assert "maxx >= ?" in where and "minx <= ?" in where and values == [3.0, 4.5] and where.count("?") == 2
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert 0 < len(rows) < len(features) and all(r[4] >= 3 - 1e-5 and r[2] <= 4.5 + 1e-5 for r in rows)


def test_layers_and_errors(spark, tmp_path, features):
    two = write(tmp_path / "two.gpkg", features[:3], layers=("one", "two"), tree=False)
    with pytest.raises(geopackage.LayerError, match="LAYER_REQUIRED_FOR_MULTI_LAYER_SOURCE"):
        geopackage.inspect(two)
    with pytest.raises(geopackage.LayerError, match="LAYER_NOT_FOUND"):
        geopackage.inspect(two, "three")
    found = geopackage.inspect(two, "two")
    assert (found["layer"], found["features"], found["epsg"], found["bounds_wgs84"]) == ("two", 3, 4326, [0, 0, 10, 10]) and found["fields"][0] == {"name": "code", "type": "string"}
    assert geopackage.read(spark, two, "one").where("xmin <= 100").count() == 3
    with pytest.raises(geopackage.LayerError, match="LAYER_CRS_UNSUPPORTED"):
        geopackage.inspect(write(tmp_path / "utm.gpkg", features[:3], srs=32631))
    with pytest.raises(geopackage.LayerError, match="LAYER_FILE_OPEN_FAILED"):
        geopackage.inspect(str(tmp_path / "none.gpkg"))
    plane = [[[(0.0, 0.0), (111319.49079327358, 0.0), (111319.49079327358, 111325.14286638486), (0.0, 0.0)]]]
    mercator = write(tmp_path / "m.gpkg", [(1, plane, blob(plane, srs=3857))], srs=3857)
    corner = geopackage.read(spark, mercator).first().polygons[0][0][2]
    assert corner.lon == pytest.approx(1.0) and corner.lat == pytest.approx(1.0)
    assert geopackage.read(spark, write(tmp_path / "empty.gpkg", [])).collect() == []


def test_export_lines(spark, tmp_path):
    bow = [[[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]]]
    fine = [[square(5.0, 5.0, 1.0)]]
    path = write(tmp_path / "x.gpkg", [(1, bow, blob(bow)), (2, fine, blob(fine))])
    geopackage.export(geopackage.read(spark, path), str(tmp_path / "out"))
    lines = {r["id"]: r for r in map(json.loads, (x.value for x in spark.read.text(str(tmp_path / "out")).collect()))}
    assert lines["2"] == {"id": "2", "properties": {"code": "c2", "buildings": 4, "density": 0.5, "urban": False}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]]]}, "repaired": False}
    assert lines["1"]["repaired"] and sorted(sorted(map(tuple, s[0][:-1])) for s in lines["1"]["geometry"]["coordinates"]) == [[(0.0, 0.0), (0.0, 2.0), (1.0, 1.0)], [(1.0, 1.0), (2.0, 0.0), (2.0, 2.0)]]
    flat = [[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]]
    bad = write(tmp_path / "bad.gpkg", [(9, flat, blob(flat))])
    with pytest.raises(Exception, match="INVALID_GEOMETRY_UNREPAIRABLE: 9"):
        geopackage.export(geopackage.read(spark, bad), str(tmp_path / "none"))


def area(faces):
    return sum(repair.signed_area(r) for f in faces for r in f)


def test_repair_cases():
    cases = [
        ([[(0, 0), (4, 4), (4, 0), (0, 4)]], 8, 2, 0),  # bow-tie
        ([square(0, 0, 2), square(5, 0, 1)], 20, 2, 0),  # a hole outside
        ([square(0, 0, 2), square(2, 0, 1)], 16, 2, 0),  # a hole half outside
        ([square(0, 0, 2), square(0, 0, 2)], 0, 0, 0),  # a hole as large as its shell
        ([square(0, 0, 3), square(0, 0, 2), square(0, 0, 1)], 24, 2, 1),  # an island
        ([[(0, 0), (6, 0), (6, 4), (4, 4), (4, 0), (2, 0), (2, 4), (0, 4)]], 16, 2, 0),  # an edge run over twice
        ([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (1, 2), (2, 1)]], 15, 1, 1),  # a ring that meets itself in a corner
        ([[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (4, 0), (4, 4), (0, 4)]], 12, 1, 0),  # turned around a part twice
    ]
    for rings, size, shells, holes in cases:
        faces, was_valid = repair.valid_faces(rings)
        assert area(faces) == pytest.approx(size) and len(faces) == shells and sum(len(f) - 1 for f in faces) == holes and not was_valid
        again = [repair.valid_faces(f) for f in faces]
        assert all(ok and area(f) == pytest.approx(area([face])) for (f, ok), face in zip(again, faces))
    assert repair.valid_faces([[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 4)]]) == ([[[(0, 0), (4, 0), (4, 4), (0, 4)]]], True)  # repeated corners
    for rings in ([square(0, 0, 2)], [square(0, 0, 2), square(0, 0, 1)], [square(0, 0, 2)[::-1]], [square(0, 0, 3), square(-1, 0, 0.5), square(1, 0, 0.5)]):
        assert repair.valid_faces(rings)[1]
    assert repair.valid_faces([]) == ([], False) and repair.valid_faces([[(0, 0), (1, 1)]]) == ([], False)


def test_repair_keeps_what_lies_in_an_odd_number_of_rings():
    draw = random.Random(6)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(0, 10, 0.05) + 0.0251, np.arange(0, 10, 0.05) + 0.0253))
    for _ in range(25):
        rings = [[(draw.uniform(0, 10), draw.uniform(0, 10)) for _ in range(draw.randrange(3, 9))] for _ in range(draw.randrange(1, 3))]
        faces, _ = repair.valid_faces(rings)

        def odd(shapes):
            found = np.zeros(len(x), bool)
            for ring in shapes:
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                    if ay != by:
                        found ^= ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
            return found

        assert (odd(rings) == odd([r for f in faces for r in f])).mean() > 0.9999
        assert all(ok for _, ok in map(repair.valid_faces, faces))
        assert all(len({*r}) == len(r) for f in faces for r in f) and math.isfinite(area(faces))


def test_repaired_frame(spark):
    rows = [("a", [[[{"lon": 0.0, "lat": 0.0}, {"lon": 2.0, "lat": 2.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 0.0, "lat": 2.0}]]], 5), ("b", None, 6)]
    frame = spark.createDataFrame(rows, f"id string, polygons {repair.POLYGONS}, n int")
    got = {r.id: r for r in repair.repaired(frame, "id").collect()}
    assert got["a"].repaired and len(got["a"].polygons) == 2 and got["a"].n == 5 and got["b"].polygons == []
    assert repair.repaired(frame.where(F.lit(False)), "id").collect() == []
