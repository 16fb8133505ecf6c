"""The tiled overlay against coordinate compression, sampling and closed forms, and the polygon joins that feed it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import overlay, polygons, settlement


def square(x, y, h, k=None):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + (h if k is None else k))]


def planes(spark, shapes, site="s"):
    """``shapes``: lists of rings of metres around the site."""
    rows = [(site, 0.0, f"p{i}", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "site_id string, distance double, polygon_id string, plane array<array<struct<x:double,y:double>>>").repartition(3)


def boxes_by_compression(boxes):
    """Area and parts of a union of axis-parallel boxes; boxes that share a side of some length are one part."""
    xs, ys = (sorted({b[k] for b in boxes} | {b[k + 2] for b in boxes}) for k in (0, 1))
    full = {(i, j) for i in range(len(xs) - 1) for j in range(len(ys) - 1) if any(b[0] <= xs[i] and b[2] >= xs[i + 1] and b[1] <= ys[j] and b[3] >= ys[j + 1] for b in boxes)}
    size = lambda c: (xs[c[0] + 1] - xs[c[0]]) * (ys[c[1] + 1] - ys[c[1]])
    parts, left = [], set(full)
    while left:
        stack, area = [left.pop()], 0.0
        while stack:
            c = stack.pop()
            area += size(c)
            for d in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                n = (c[0] + d[0], c[1] + d[1])
                if n in left:
                    left.remove(n)
                    stack.append(n)
        parts.append(area)
    return sum(parts), sorted(parts)


@pytest.mark.parametrize("tiles", [1, 2, 8, 13])
def test_boxes_equal_compression(spark, tiles):
    draw = random.Random(4)
    boxes = []
    for _ in range(60):
        x, y = draw.randrange(-60, 50), draw.randrange(-60, 50)
        boxes.append((x, y, x + draw.randrange(1, 16), y + draw.randrange(1, 16)))
    shapes = [[[(a, b), (c, b), (c, d), (a, d)]] for a, b, c, d in boxes]
    got = overlay.union_within(planes(spark, shapes), [100], tiles).collect()
    area, parts = boxes_by_compression(boxes)
    assert len(got) == 1 and got[0].settled_m2 == pytest.approx(area) and got[0].n_parts == len(parts) and got[0].largest_m2 == pytest.approx(parts[-1]) and got[0].n_extents == 60


def test_closed_forms(spark):
    def union(shapes, radius=1000, tiles=8):
        found = overlay.union_within(planes(spark, shapes), [radius], tiles).collect()
        return (found[0].settled_m2, found[0].n_parts, found[0].largest_m2) if found else (0.0, 0, 0.0)

    assert union([[square(0, 0, 10)], [square(5, 5, 10)], [square(50, 0, 5)]]) == pytest.approx((675, 2, 575))
    assert union([[square(0, 0, 10), square(0, 0, 4)]]) == pytest.approx((400 - 64, 1, 400 - 64))
    assert union([[square(0, 0, 10), square(0, 0, 4)], [square(0, 0, 2)]]) == pytest.approx((400 - 64 + 16, 2, 400 - 64))
    assert union([[square(500, 0, 10)]], 100) == (0.0, 0, 0.0)
    # Neighbours that share a side are one part, across tiles and within; those that share a corner are two.
    assert union([[square(0, 0, 10)], [square(20, 0, 10)]])[1] == 1 and union([[square(0, 0, 10)], [square(20, 20, 10)]])[1] == 2
    assert union([[square(0, 0, 500)], [square(0, 0, 500)]], 400)[0] == pytest.approx(16 * 400**2 * math.sin(math.pi / 16))
    # A ring around the circle's centre whose arms meet in one tile only.
    horseshoe = [(-50, -50), (50, -50), (50, 50), (40, 50), (40, -40), (-40, -40), (-40, 50), (-50, 50)]
    assert union([[horseshoe]], 100) == pytest.approx((100 * 100 - 80 * 90, 1, 2800))
    assert union([[[(0, 0), (10, 10)]], [[]]]) == (0.0, 0, 0.0)


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
    return odd


def test_shapes_by_sampling(spark):
    """Stars with holes, cut by the circle; the same whatever the tiles."""
    draw = random.Random(8)
    shapes = []
    for _ in range(25):
        cx, cy, r = draw.uniform(-90, 90), draw.uniform(-90, 90), draw.uniform(10, 45)
        star = lambda f, cx=cx, cy=cy, r=r: [(cx + f * r * s * math.cos(a), cy + f * r * s * math.sin(a)) for a, s in ((2 * math.pi * k / 11, draw.uniform(0.5, 1)) for k in range(11))]
        shapes.append([star(1.0), star(0.3)])
    found = [overlay.union_within(planes(spark, shapes), [80], tiles).collect()[0] for tiles in (1, 5, 8)]
    for f in found[1:]:
        assert (f.n_extents, f.n_parts) == (found[0].n_extents, found[0].n_parts) and f.settled_m2 == pytest.approx(found[0].settled_m2) and f.largest_m2 == pytest.approx(found[0].largest_m2)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(-80, 80, 0.2) + 0.1, np.arange(-80, 80, 0.2) + 0.1))
    ring = [(80 * math.cos(2 * math.pi * k / 32), 80 * math.sin(2 * math.pi * k / 32)) for k in range(32)]
    held = inside([ring], x, y) & np.any([inside(s, x, y) for s in shapes], axis=0)
    assert found[0].settled_m2 == pytest.approx(held.sum() * 0.04, rel=2e-3)


def test_a_polygon_is_cut_before_the_shuffle():
    """A ring that covers the circle comes to each tile as a few corners."""
    many = np.array([(900 * math.cos(a), 900 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 20_000, endpoint=False)])
    found = list(overlay.pieces([many], 500.0, 8))
    assert sum(len(r) for _, _, part in found for r in part) < 600 and sum(abs(overlay._area(r)) for _, _, part in found for r in part) == pytest.approx(16 * 500**2 * math.sin(math.pi / 16))


def rings(*corners):
    return [[{"lon": x, "lat": y} for x, y in ring] for ring in corners]


POLYGON = "polygon_id string, rings array<array<struct<lon:double,lat:double>>>"


def test_context_of_sites(spark):
    sites = spark.createDataFrame([("in", 5.0, 6.0), ("out", 5.02, 6.0), ("far", 9.0, 9.0)], "site_id string, lon double, lat double")
    extents = spark.createDataFrame([("small", rings(square(5.0, 6.0, 0.001))), ("large", rings(square(5.0, 6.0, 0.004))), ("beside", rings(square(5.027, 6.0, 0.001)))], POLYGON)
    coverage = spark.createDataFrame([("c", rings(square(5.0, 6.0, 0.03)))], POLYGON)
    got = {(r.site_id, r.radius): r for r in settlement.context(sites, extents, coverage, [300, 1500], 2000.0).collect()}
    assert set(got) == {(s, r) for s in ("in", "out", "far") for r in (300, 1500)}
    r = got["in", 300]
    assert (r.inside, r.n_containing, r.primary_id, r.nearest_m, r.coverage_status) == (True, 2, "small", 0.0, "complete")
    assert r.settled_share == pytest.approx(1.0) and r.largest_share == 1.0 and r.n_parts == 1 and 0.75 < r.compactness < 0.79 and r.core_depth_m == pytest.approx(110.6, abs=0.5)
    r = got["out", 1500]
    assert (r.inside, r.n_containing, r.primary_id, r.n_parts, r.n_extents, r.source_covered) == (False, 0, None, 1, 1, False) and r.nearest_m == pytest.approx(664, abs=2) and r.core_depth_m is None
    r = got["far", 300]
    assert (r.settled_m2, r.n_parts, r.largest_share, r.nearest_m, r.coverage_status) == (0.0, 0, None, None, "partial_source_coverage")
    none = settlement.context(sites, extents.limit(0), coverage.limit(0), [300], 300.0).collect()
    assert len(none) == 3 and all(r.settled_m2 == 0.0 and not r.source_covered for r in none)


def test_polygons_of_all_sizes_stand_in_few_cells(spark):
    shapes = spark.createDataFrame([("house", rings(square(3.0, 6.0, 0.0001))), ("town", rings(square(3.0, 6.0, 0.2))), ("country", rings(square(8.0, 9.0, 6.0))), ("globe", rings(square(0.0, 0.0, 90.0)))], POLYGON)
    draw = random.Random(2)
    table = [(i, draw.uniform(2, 4), draw.uniform(5, 7)) for i in range(300)] + [(300, 3.0, 6.0)]
    points = spark.createDataFrame(table, "id int, lon double, lat double")
    found = polygons.containing(points, shapes)
    want = {(i, name) for i, x, y in table for name, cx, cy, h in (("house", 3, 6, 0.0001), ("town", 3, 6, 0.2), ("country", 8, 9, 6), ("globe", 0, 0, 90)) if abs(x - cx) <= h and abs(y - cy) <= h}
    assert {(r.id, r.polygon_id) for r in found.collect()} == want and found.count() == len(want)
    placed = polygons._candidates(points, polygons.boxed(shapes), 0.01)
    assert placed.where("polygon_id = 'country'").count() <= len(table)
    measured = shapes.select("polygon_id", polygons.plane(F.col("rings"), F.lit(3.0), F.lit(6.0)).alias("plane")).select("polygon_id", polygons.plane_area(F.col("plane")).alias("area"), polygons.plane_perimeter(F.col("plane")).alias("around"))
    r = {r.polygon_id: r for r in measured.collect()}["town"]
    assert r.area == pytest.approx((r.around / 4) ** 2, rel=1e-4)


def test_mid_ranks(spark):
    from marquee.operators import checks, ranks

    draw = random.Random(3)
    cohort = [float(draw.randrange(200)) for _ in range(3000)] + [7.0] * 4000 + [None]
    asked = [float(v) for v in range(-3, 205)] + [7.0, 7.5, None]
    frame = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, value double").repartition(4)
    members = [v for v in cohort if v is not None]
    for n in (2, 64):
        got = {r.value: (r.below, r.same, r.total) for r in ranks.mid_ranks(frame(cohort), frame(asked), n).collect()}
        assert got == {v: (sum(m < v for m in members), members.count(v), len(members)) for v in set(asked) - {None}}
    kept = checks.activity_potential(frame(asked), frame(cohort), ["id"]).collect()
    assert len(kept) == len(asked) and {r.id: r.potential for r in kept}[len(asked) - 1] is None
    assert all(r.potential is None for r in checks.activity_potential(frame(asked), frame(cohort[:5]), ["id"]).collect())
    assert all(r.potential is None for r in checks.activity_potential(frame(asked), frame([None]), ["id"]).collect()) and ranks.mid_ranks(frame(cohort), frame([None])).collect() == []
