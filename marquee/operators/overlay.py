"""Union of polygons within circles, as a planar overlay that is cut into tiles.

Each polygon is taken to the plane around its site and cut by the circle's tiles where
it lies, before anything is shuffled, so a task gets short pieces and never a whole
polygon.  A tile's pieces are overlaid in vertical slabs between all abscissas at which
edges begin, end or cross: within a slab no edges cross, so the covered height is a
union of intervals, and intervals that touch from slab to slab are one part.  A tile
gives the areas of its parts and the stretches of its sides that they reach.  Parts
that reach the same stretch of a common side are one part of the circle; only these
narrow rows come together by circle.

The tiles of a circle are TILES to a side, whatever its radius, so a dense circle is
many groups; around a site with few corners (FEW) a circle is one tile.  A polygon is an array of rings, each an array of lon/lat structs, the
first the outer one; what lies within an odd number of its rings belongs to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiles to a side of a circle's box, and corners of the polygon that stands for the circle.
TILES, CORNERS = 8, 32
#: Up to so many corners of all polygons near a site, its circles are not cut into tiles.
FEW = 400
#: Metres below which heights, widths and stretches count as nothing.
EPS = 1e-7

Ring = np.ndarray
_PIECE = "site_id string, radius int, tiles int, tx int, ty int, polygon_id string, xs array<array<double>>, ys array<array<double>>"
_TILE = "site_id string, radius int, polygon_id string, tile int, part int, area double, side string, low double, high double"
_CIRCLE = "site_id string, radius int, n_extents int, settled_m2 double, n_parts int, largest_m2 double, met array<string>"


def circle_area(radius: Column) -> Column:
    return radius * radius * F.lit(CORNERS / 2 * math.sin(2 * math.pi / CORNERS))


def cut(ring: Ring, axis: int, at: float, keep_below: bool) -> Ring:
    """The part of a ring (n x 2) on one side of an axis-parallel line; new corners lie on the line exactly."""
    if not len(ring):
        return ring
    c = ring[:, axis]
    inside = c <= at if keep_below else c >= at
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    after = np.roll(ring, -1, axis=0)
    crossing = inside != np.roll(inside, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (at - c) / (after[:, axis] - c)
        met = ring + t[:, None] * (after - ring)
    met[:, axis] = at
    # Each corner that stays is followed by the place where its edge crosses the line, if it does.
    both = np.stack([ring, met], axis=1).reshape(-1, 2)
    return both[np.stack([inside, crossing], axis=1).ravel()]


def cut_by_circle(ring: Ring, radius: float) -> Ring:
    """The part of a ring within the circle's polygon around the origin."""
    if not len(ring) or (np.hypot(ring[:, 0], ring[:, 1]) <= radius * math.cos(math.pi / CORNERS)).all():
        return ring
    for k in range(CORNERS):
        a = 2 * math.pi * (k + 0.5) / CORNERS
        normal = np.array([math.cos(a), math.sin(a)])
        d = ring @ normal - radius * math.cos(math.pi / CORNERS)
        inside = d <= 0
        if inside.all():
            continue
        after, d_after = np.roll(ring, -1, axis=0), np.roll(d, -1)
        crossing = inside != np.roll(inside, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            met = ring + (d / (d - d_after))[:, None] * (after - ring)
        ring = np.stack([ring, met], axis=1).reshape(-1, 2)[np.stack([inside, crossing], axis=1).ravel()]
        if not len(ring):
            break
    return ring


def pieces(rings: list[Ring], radius: float, tiles: int) -> Iterator[tuple[int, int, list[Ring]]]:
    """The rings within each tile of a circle's box; halves are halved again, so a ring's corners are met a few times each."""
    width = 2 * radius / tiles
    line = lambda k: -radius + k * width

    def halve(part: list[Ring], x0: int, x1: int, y0: int, y1: int) -> Iterator[tuple[int, int, list[Ring]]]:
        part = [r for r in part if len(r) > 2]
        if not part:
            return
        if x1 - x0 == 1 and y1 - y0 == 1:
            found = [r for r in (cut_by_circle(r, radius) for r in part) if len(r) > 2]
            if found:
                yield x0, y0, found
            return
        axis = 0 if x1 - x0 >= y1 - y0 else 1
        mid = (x0 + x1) // 2 if axis == 0 else (y0 + y1) // 2
        low, high = ([cut(r, axis, line(mid), below) for r in part] for below in (True, False))
        yield from halve(low, x0, mid if axis == 0 else x1, y0, mid if axis == 1 else y1)
        yield from halve(high, mid if axis == 0 else x0, x1, mid if axis == 1 else y0, y1)

    for axis in (0, 1):
        for at, below in ((radius, True), (-radius, False)):
            rings = [cut(r, axis, at, below) for r in rings]
    yield from halve(rings, 0, tiles, 0, tiles)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            site, radius, tiles, polygon = (batch.column(c)[k].as_py() for c in ("site_id", "radius", "tiles", "polygon_id"))
            rings = [np.array([[p["x"], p["y"]] for p in ring], float).reshape(-1, 2) for ring in batch.column("plane")[k].as_py()]
            found = list(pieces(rings, float(radius), tiles))
            if not found:
                continue
            n = len(found)
            cells = [[[r[:, axis].tolist() for r in part] for _, _, part in found] for axis in (0, 1)]
            numbers = ([radius] * n, [tiles] * n, [x for x, _, _ in found], [y for _, y, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([site] * n, pa.string()), *(pa.array(v, pa.int32()) for v in numbers), pa.array([polygon] * n, pa.string()), *(pa.array(c, pa.list_(pa.list_(pa.float64()))) for c in cells)],
                names=["site_id", "radius", "tiles", "tx", "ty", "polygon_id", "xs", "ys"],
            )


def edges_of(rings: list[Ring]) -> np.ndarray:
    """Edges (x1, y1, x2, y2) from left to right; upright ones bound no height."""
    found = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings]
    e = np.concatenate(found) if found else np.empty((0, 4))
    e = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
    return e[e[:, 2] - e[:, 0] > 0]


def crossings(e: np.ndarray) -> np.ndarray:
    """Abscissas at which edges cross; each edge is tried with those whose boxes it meets."""
    found = []
    order = np.argsort(e[:, 0], kind="stable")
    e = e[order]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for k in range(len(e) - 1):
        last = np.searchsorted(e[:, 0], e[k, 2])
        o = e[k + 1 : last][(low[k + 1 : last] <= high[k]) & (high[k + 1 : last] >= low[k])]
        if not len(o):
            continue
        x1, y1, x2, y2 = e[k]
        dx, dy, ex, ey = x2 - x1, y2 - y1, o[:, 2] - o[:, 0], o[:, 3] - o[:, 1]
        det = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((o[:, 0] - x1) * ey - (o[:, 1] - y1) * ex) / det
            u = ((o[:, 0] - x1) * dy - (o[:, 1] - y1) * dx) / det
        hit = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        found.append(x1 + t[hit] * dx)
    return np.concatenate(found) if found else np.empty(0)


class Parts:
    """Union-find over numbered parts."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def new(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def touching_stretches(one: list[tuple], other: list[tuple]) -> Iterator[tuple[int, int]]:
    """Owners of stretches (low, high, owner) of two ordered lists that share more than a point."""
    i = j = 0
    while i < len(one) and j < len(other):
        if min(one[i][1], other[j][1]) - max(one[i][0], other[j][0]) > EPS:
            yield one[i][2], other[j][2]
        if one[i][1] < other[j][1]:
            i += 1
        else:
            j += 1


def overlaid(polygons: list[list[Ring]], box: tuple[float, float, float, float]) -> tuple[dict[int, float], list[tuple[str, float, float, int]]]:
    """The parts of the union of polygons that lie within a box: their areas, and the stretches of the box's sides they reach.

    Sides are ``w``, ``e`` (stretches of y) and ``s``, ``n`` (of x).
    """
    west, south, east, north = box
    groups = [edges_of(rings) for rings in polygons]
    flat, owner = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    parts, areas, sides = Parts(), [], []
    if not len(flat):
        return {}, []
    xs = np.unique(np.concatenate([flat[:, 0], flat[:, 2], crossings(flat)]))
    slope = (flat[:, 3] - flat[:, 1]) / (flat[:, 2] - flat[:, 0])
    before: list[tuple[float, float, int]] = []
    for a, b in zip(xs, xs[1:]):
        if b - a < 1e-9:
            continue
        on = np.flatnonzero((flat[:, 0] <= a + 1e-9) & (flat[:, 2] >= b - 1e-9))
        at, to = (flat[on, 1] + slope[on] * (x - flat[on, 0]) for x in (a, b))
        order = np.lexsort((at + to, owner[on]))
        at, to = at[order], to[order]
        # Of each polygon an even number of edges passes the slab; every second stretch between them is inside.
        n = len(order) // 2 * 2
        stretch = np.stack([at[:n:2], to[:n:2], at[1:n:2], to[1:n:2]], axis=1)
        stretch = stretch[np.argsort(stretch[:, 0] + stretch[:, 1], kind="stable")]
        merged: list[list[float]] = []
        for low_a, low_b, high_a, high_b in stretch.tolist():
            if merged and low_a + low_b <= merged[-1][2] + merged[-1][3] + EPS:
                if high_a + high_b > merged[-1][2] + merged[-1][3]:
                    merged[-1][2:] = high_a, high_b
            elif high_a + high_b - low_a - low_b > EPS:
                merged.append([low_a, low_b, high_a, high_b])
        now, start = [], []
        for low_a, low_b, high_a, high_b in merged:
            k = parts.new()
            areas.append((b - a) * (high_a - low_a + high_b - low_b) / 2)
            start.append((low_a, high_a, k))
            now.append((low_b, high_b, k))
            if abs(a - west) <= EPS:
                sides.append(("w", low_a, high_a, k))
            if abs(b - east) <= EPS:
                sides.append(("e", low_b, high_b, k))
            if max(abs(low_a - south), abs(low_b - south)) <= EPS:
                sides.append(("s", a, b, k))
            if max(abs(high_a - north), abs(high_b - north)) <= EPS:
                sides.append(("n", a, b, k))
        for one, other in touching_stretches(before, start):
            parts.join(one, other)
        before = now
    whole: dict[int, float] = {}
    for k, area in enumerate(areas):
        whole[parts.find(k)] = whole.get(parts.find(k), 0.0) + area
    return whole, [(side, low, high, parts.find(k)) for side, low, high, k in sides if high - low > EPS]


def _overlay(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    site, radius, tiles, tx, ty = (k.as_py() for k in key)
    width, names = 2 * radius / tiles, table.column("polygon_id").to_pylist()
    rings = [[np.array([x, y]).T for x, y in zip(xs, ys)] for xs, ys in zip(table.column("xs").to_pylist(), table.column("ys").to_pylist())]
    areas, sides = overlaid(rings, tuple(-radius + k * width for k in (tx, ty, tx + 1, ty + 1)))
    rows = [(None, part, area, None, None, None) for part, area in areas.items()] + [(None, part, None, side, low, high) for side, low, high, part in sides]
    rows += [(name, None, None, None, None, None) for name, part in zip(names, rings) if sum(abs(_area(r)) for r in part) > EPS]
    kinds = dict(polygon_id=pa.string(), part=pa.int32(), area=pa.float64(), side=pa.string(), low=pa.float64(), high=pa.float64())
    columns = {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())}
    n = len(rows)
    columns |= {"site_id": pa.array([site] * n, pa.string()), "radius": pa.array([radius] * n, pa.int32()), "tile": pa.array([ty * tiles + tx] * n, pa.int32())}
    return pa.table({c.split(" ")[0]: columns[c.split(" ")[0]] for c in _TILE.split(", ")})


def _area(ring: Ring) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def _whole(tiles: int):
    def circle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The circle's parts, from its tiles' parts and the stretches of common sides."""
        parts, number, area = Parts(), {}, {}
        reached: dict[tuple[str, int], list[tuple[float, float, int]]] = {}
        names = set()
        for row in table.to_pylist():
            if row["polygon_id"] is not None:
                names.add(row["polygon_id"])
                continue
            own = (row["tile"], row["part"])
            if own not in number:
                number[own] = parts.new()
            k = number[own]
            if row["area"] is not None:
                area[k] = row["area"]
            else:
                reached.setdefault((row["side"], row["tile"]), []).append((row["low"], row["high"], k))
        for stretches in reached.values():
            stretches.sort()
        for side, back, step in (("e", "w", 1), ("n", "s", tiles)):
            for (name, tile), stretches in reached.items():
                if name == side:
                    for a, b in touching_stretches(stretches, reached.get((back, tile + step), [])):
                        parts.join(a, b)
        sizes: dict[int, float] = {}
        for k, a in area.items():
            sizes[parts.find(k)] = sizes.get(parts.find(k), 0.0) + a
        found = [a for a in sizes.values() if a > 1e-6]
        values = [key[0].as_py(), key[1].as_py(), len(names), math.fsum(found), len(found), max(found, default=0.0), sorted(names)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.string())]
        return pa.table({c.split(" ")[0]: pa.array([v], kind) for c, v, kind in zip(_CIRCLE.split(", "), values, kinds)})

    return circle


def union_within(near: DataFrame, radii: list[int], tiles: int | None = None) -> DataFrame:
    """Per site and radius, the area of the union of polygons, its parts and the largest part, and the ids of the polygons met.

    ``near``: site_id, distance, polygon_id and ``plane``, the polygon's rings as arrays of x/y structs in metres around
    the site.  A circle that no polygon meets has no row.  Without ``tiles`` a circle has TILES to a side, or one if there
    are few corners near its site.
    """
    corners = F.sum(F.aggregate("plane", F.lit(0), lambda n, r: n + F.size(r))).over(Window.partitionBy("site_id"))
    sized = near.select("site_id", "distance", F.col("polygon_id").cast("string").alias("polygon_id"), "plane", (F.when(corners <= FEW, 1).otherwise(TILES) if tiles is None else F.lit(tiles)).cast("int").alias("tiles"))
    each = sized.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii]).cast("array<int>"))).where("distance <= radius")
    placed = each.select("site_id", "radius", "tiles", "polygon_id", "plane").mapInArrow(_cut, _PIECE)
    overlay = placed.groupBy("site_id", "radius", "tiles", "tx", "ty").applyInArrow(_overlay, _TILE)
    return overlay.groupBy("site_id", "radius").applyInArrow(_whole(tiles or TILES), _CIRCLE)
