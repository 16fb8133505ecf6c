"""GeoTIFF files that the tests write, windows against a plain cut, and walks over uneven ground against a plain version."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import affine
from marquee.operators import raster
from marquee.sources import tiff


def write(path, values, gt, tile=None, rows=None, kind="f4", order="<", deflate=False, predictor=1, nodata=None, epsg=4326, big=False, point=False, samples=1, matrix=False):
    """A GeoTIFF of one image, in tiles (square, ``tile`` wide) or strips of ``rows``."""
    h, w = values.shape
    tw, th = (tile, tile) if tile else (w, rows or h)
    parts = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            block = np.zeros((th if tile or r + th <= h else h - r, tw))
            part = values[r : r + th, c : c + tw]
            block[: part.shape[0], : part.shape[1]] = part
            full = np.repeat(block[:, :, None], samples, axis=2).astype(order + kind)
            if predictor == 2:
                full[:, 1:] = np.diff(full, axis=1)
            data = full.tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(full.astype(">" + kind)).view(np.uint8).reshape(full.shape[0], -1, np.dtype(kind).itemsize).transpose(0, 2, 1).reshape(full.shape[0], -1)
                planes = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
                data = planes.astype(np.uint8).tobytes()
            parts.append(zlib.compress(data) if deflate else data)
    base = 16 if big else 8
    offsets = np.cumsum([0, *map(len, parts)])[:-1] + base
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [8 * np.dtype(kind).itemsize] * samples), (259, "H", [8 if deflate else 1]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [{"f": 3, "i": 2, "u": 1}[kind[0]]] * samples)]
    tags += [(322, "I", [tw]), (323, "I", [th]), (324, "Q" if big else "I", offsets.tolist()), (325, "I", [len(p) for p in parts])] if tile else [(273, "Q" if big else "I", offsets.tolist()), (278, "I", [th]), (279, "I", [len(p) for p in parts])]
    if matrix:
        tags.append((34264, "d", [gt[1], gt[2], 0, gt[0], gt[4], gt[5], 0, gt[3], 0, 0, 0, 0, 0, 0, 0, 1]))
    else:
        tags += [(33550, "d", [gt[1], -gt[5], 0.0]), (33922, "d", [0.0, 0.0, 0.0, gt[0] + (0.5 * gt[1] if point else 0), gt[3] + (0.5 * gt[5] if point else 0), 0.0])]
    tags.append((34735, "H", [1, 1, 0, 2, 1025, 0, 1, 2 if point else 1, 2048, 0, 1, epsg]))
    if nodata is not None:
        tags.append((42113, "c", list(f"{nodata}\0".encode())))
    tags.sort()
    ifd = base + sum(map(len, parts))
    width, head, inline = (20, 8, 8) if big else (12, 2, 4)
    extra_at = ifd + head + width * len(tags) + (8 if big else 4)
    entries, extra = b"", b""
    for tag, letter, items in tags:
        raw = bytes(items) if letter == "c" else struct.pack(f"{order}{len(items)}{letter}", *items)
        kind_no = {"H": 3, "I": 4, "d": 12, "c": 2, "Q": 16}[letter]
        entries += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind_no, len(items))
        if len(raw) <= inline:
            entries += raw.ljust(inline, b"\0")
        else:
            entries += struct.pack(f"{order}{'Q' if big else 'I'}", extra_at + len(extra))
            extra += raw
    start = {"<": b"II", ">": b"MM"}[order] + (struct.pack(f"{order}HHHQ", 43, 8, 0, ifd) if big else struct.pack(f"{order}HI", 42, ifd))
    data = start + b"".join(parts) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + b"\0" * (8 if big else 4) + extra
    path.write_bytes(data)
    return str(path)


GT = (3.0, 0.01, 0.0, 7.0, 0.0, -0.02)
LAYOUTS = [
    dict(tile=16), dict(tile=16, kind="f8", order=">", deflate=True), dict(tile=32, kind="i2", deflate=True, predictor=2), dict(tile=16, kind="f4", deflate=True, predictor=3), dict(rows=7), dict(rows=7, deflate=True, kind="u1"),
    dict(kind="i4", order=">"), dict(tile=16, big=True, kind="u2"), dict(tile=16, point=True), dict(tile=16, samples=3, kind="u1"), dict(rows=10, samples=2, deflate=True, predictor=2, kind="i4"), dict(tile=16, matrix=True),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_tiles_hold_the_values(spark, tmp_path, layout):
    values = np.random.default_rng(1).integers(0, 100, (45, 61)).astype(float)
    path = write(tmp_path / "a.tif", values, GT, nodata=-9, **layout)
    found = tiff.inspect(path)
    assert (found["width"], found["height"], found["epsg"], found["nodata"], found["rotated"]) == (61, 45, 4326, -9.0, False) and found["geotransform"] == pytest.approx(GT) and found["bounds"] == pytest.approx([3.0, 6.1, 3.61, 7.0])
    got = np.full(values.shape, np.nan)
    for r in tiff.read(spark, path, run=3).collect():
        got[r.row0 : r.row0 + r.height, r.col0 : r.col0 + r.width] = np.array(r["values"]).reshape(r.height, r.width)
    assert np.array_equal(got, values)


def test_only_wanted_tiles_are_read(spark, tmp_path):
    path = write(tmp_path / "a.tif", np.arange(64 * 64.0).reshape(64, 64), GT, tile=16)
    df = tiff.read(spark, path, run=2)
    assert df.rdd.getNumPartitions() == 8
    some = df.where("tile_row = 1 AND tile_col >= 2")
    assert {(r.tile_row, r.tile_col) for r in some.collect()} == {(1, 2), (1, 3)} and some.rdd.getNumPartitions() == 1
    assert df.where("tile_row > 1 AND tile_row < 3 AND tile_col <= 0").count() == 1


def test_headers_that_cannot_be_read(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(tiff.RasterError, match="RASTER_FORMAT_UNSUPPORTED"):
        tiff.inspect(str(tmp_path / "x.tif"))
    with pytest.raises(ValueError, match="GEOTRANSFORM_NOT_INVERTIBLE"):
        affine.inverse((0.0, 1.0, 1.0, 0.0, 1.0, 1.0))
    gt = (3.0, 0.01, 0.002, 7.0, 0.001, -0.02)
    assert affine.to_pixel(gt, *affine.to_world(gt, 5.0, 7.0)) == pytest.approx((5.0, 7.0)) and affine.part(gt, 5, 7)[:4:3] == pytest.approx(affine.to_world(gt, 5, 7))
    rotated = tiff.inspect(write(tmp_path / "r.tif", np.zeros((4, 4)), gt, tile=16, matrix=True))
    assert rotated["rotated"] and rotated["geotransform"] == pytest.approx(gt)


SITES = [("mid", 3.3037, 6.5937), ("edge", 3.0237, 6.9737), ("out", 9.0, 9.0)]


def sites(spark):
    return spark.createDataFrame(SITES, "site_id string, lon double, lat double")


def test_windows_equal_a_plain_cut(spark, tmp_path):
    values = np.random.default_rng(2).uniform(0, 9, (45, 61)).astype("f4").astype(float)
    path = write(tmp_path / "a.tif", values, GT, tile=16)
    grid = raster.Grid(GT, 61, 45, 16, 16)
    found = raster.windows(sites(spark), grid, 5_000.0)
    window = {r.site_id: r for r in found.collect()}
    assert [(window[s].covered, window[s].inside) for s, *_ in SITES] == [(True, True), (False, True), (False, False)]
    cut = {s: np.full((window[s].y1 - window[s].y0, window[s].x1 - window[s].x0), np.nan) for s in ("mid", "edge")}
    for r in raster.window_rows(found, tiff.read(spark, path), grid).collect():
        w = window[r.site_id]
        cut[r.site_id][r.row - w.y0, r.col - w.x0 : r.col - w.x0 + len(r["values"])] = r["values"]
    for s in cut:
        w = window[s]
        assert np.array_equal(cut[s], values[w.y0 : w.y1, w.x0 : w.x1])
    degrees = 5_000 / 6_371_008.8 * 180 / math.pi
    assert window["mid"].x0 == math.floor((3.3037 - degrees / math.cos(math.radians(6.5937)) - 3.0) / 0.01) - 2 and window["mid"].y1 == math.ceil((7.0 - 6.5937 + degrees) / 0.02) + 2


def plain_walk(values, start, top, sx, sy):
    cost = np.full(values.shape, np.inf)
    if np.isfinite(values[start]) and values[start] > 0:
        cost[start] = 0.0
    while True:
        before = cost.copy()
        for r, c in np.argwhere(np.isfinite(values) & (values > 0)):
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    x, y = r + a, c + b
                    if (a or b) and 0 <= x < cost.shape[0] and 0 <= y < cost.shape[1]:
                        cost[r, c] = min(cost[r, c], cost[x, y] + math.hypot(a * sy, b * sx) * (values[r, c] + values[x, y]) / 2) if np.isfinite(cost[x, y]) else cost[r, c]
        cost[cost > top] = np.inf
        if np.array_equal(before, cost):
            return cost


def test_walks_over_uneven_ground(spark):
    draw = np.random.default_rng(3)
    ways = draw.uniform(50, 900, (45, 61))
    ways[draw.random(ways.shape) < 0.15] = -1
    ways[20, 30] = 100.0  # where "mid" stands
    people = draw.integers(0, 50, (80, 70)).astype(float)
    people[draw.random(people.shape) < 0.1] = np.nan
    w, p = raster.Grid(GT, 61, 45, 16, 16), raster.Grid((2.981, 0.008, 0.0, 7.03, 0.0, -0.011), 70, 80, 16, 16, -5.0)
    cells = lambda a, **k: [dict(row=r, col=c, value=None if math.isnan(v) else float(v), **k) for (r, c), v in np.ndenumerate(a)]
    friction = raster.tiled(spark.createDataFrame(cells(ways, mode="walking") + cells(ways / 2, mode="mixed"), "row int, col int, value double, mode string"), w, ("mode",))
    lived = raster.tiled(spark.createDataFrame(cells(np.where(np.isnan(people), -5.0, people)), "row int, col int, value double"), p)
    got = {(r.site_id, r["mode"], r.minutes): r for r in raster.accessible_population(sites(spark), friction, w, lived, p, ["walking", "mixed"], [10.0, 30.0], 8_000.0).collect()}
    assert len(got) == 12
    fw, pw = ({r.site_id: r for r in raster.windows(sites(spark), g, 8_000.0).collect()} for g in (w, p))
    for site, lon, lat in SITES[:2]:
        f, q = fw[site], pw[site]
        for mode, scale in (("walking", 1.0), ("mixed", 0.5)):
            start = (math.floor((7.0 - lat) / 0.02) - f.y0, math.floor((lon - 3.0) / 0.01) - f.x0)
            cost = plain_walk((ways * scale)[f.y0 : f.y1, f.x0 : f.x1], start, 30.0, 0.01, 0.02)
            blocked = not np.isfinite(cost).any()
            for m in (10.0, 30.0):
                total = n = 0
                for r in range(q.y0, q.y1):
                    for c in range(q.x0, q.x1):
                        y, x = math.floor((7.0 - (7.03 - (r + 0.5) * 0.011)) / 0.02) - f.y0, math.floor((2.981 + (c + 0.5) * 0.008 - 3.0) / 0.01) - f.x0
                        if 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1] and cost[y, x] <= m and not math.isnan(people[r, c]):
                            total, n = total + people[r, c], n + 1
                r = got[site, mode, m]
                assert (r.population, r.n_reachable, r.n_friction_cells) == (pytest.approx(total), n, (cost <= m).sum())
                assert r.n_candidates == (q.y1 - q.y0) * (q.x1 - q.x0) == r.n_valid + r.n_nodata and r.n_valid == np.isfinite(people[q.y0 : q.y1, q.x0 : q.x1]).sum()
                assert (r.status == "friction_cell_unavailable") == blocked
    assert got["out", "mixed", 30.0].status == "outside_source_coverage" and got["out", "mixed", 30.0].population == 0.0
    assert got["mid", "mixed", 30.0].population >= got["mid", "walking", 30.0].population > 0
    rings = {(r.site_id, r.radius): r for r in raster.population_within(sites(spark), lived, p, [1000, 4000]).collect()}
    assert rings["out", 1000].status == "outside_source_coverage" and rings["mid", 4000].n_candidates == rings["mid", 4000].n_valid + rings["mid", 4000].n_nodata > rings["mid", 1000].n_candidates > 0
    assert raster.population_within(sites(spark).where(F.lit(False)), lived, p, [1000]).collect() == []


def test_rings_measure_positions(spark, monkeypatch):
    """Windows are opened for positions, whatever the number of sites there; a site without a position has none."""
    grid, met, rows = raster.Grid(GT, 40, 40, 16, 16), [], raster.window_rows
    lived = raster.tiled(spark.range(1600).selectExpr("id div 40 AS row", "id % 40 AS col", "id % 7 AS value"), grid)
    places = spark.range(60).selectExpr("CAST(id AS string) AS site_id", "IF(id = 59, NULL, 3.15D + id % 3 / 100) AS lon", "CAST(6.7 AS double) AS lat")
    monkeypatch.setattr(raster, "window_rows", lambda found, *a, **k: met.append(found) or rows(found, *a, **k))
    got = {(r.site_id, r.radius): r for r in raster.population_within(places, lived, grid, [1000, 4000]).collect()}
    assert len(got) == 120 and met[0].where("lon IS NOT NULL").count() == 3 and "site_id" not in met[0].columns
    for r in (1000, 4000):
        assert got["0", r][2:] == got["57", r][2:]
    assert got["0", 4000].n_candidates == got["0", 4000].n_valid > 0 and got["59", 4000][2:6] == (0.0, 0, 0, 0)


def test_walks_start_once_a_position(spark, monkeypatch):
    """Walks start from positions, whatever the number of sites there; a site without a position reaches no one."""
    grid, met, opened = raster.Grid(GT, 40, 40, 16, 16), [], raster.windows
    cells = spark.range(1600).selectExpr("id div 40 AS row", "id % 40 AS col", "200 AS value", "'walking' AS mode")
    places = spark.range(40).selectExpr("CAST(id AS string) AS site_id", "IF(id = 39, NULL, 3.15D + id % 3 / 100) AS lon", "CAST(6.7 AS double) AS lat")
    monkeypatch.setattr(raster, "windows", lambda df, *a: met.append(df) or opened(df, *a))
    ways, lived = raster.tiled(cells, grid, ("mode",)), raster.tiled(cells.drop("mode"), grid)
    got = {r.site_id: r for r in raster.accessible_population(places, ways, grid, lived, grid, ["walking"], [10.0], 8_000.0).collect()}
    assert len(got) == 40 and met[0].count() == 3 and "site_id" not in met[0].columns
    assert got["0"][1:] == got["36"][1:] and got["0"].population > 200 and got["0"].n_unavailable > 0
    assert got["39"][3:] == (0.0, 0, 0, 0, 0, 0, 0, 0.0, "outside_source_coverage")
