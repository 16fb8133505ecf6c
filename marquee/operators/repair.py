"""Valid polygons from rings that cross themselves or each other.

A point belongs to a polygon if an odd number of its rings go around it, whatever their
order.  Edges are cut where they meet; stretches that lie on each other cancel in pairs;
each one left has inside on one side and outside on the other.  Walking them with the
inside on the left gives the rings of the faces, split where a ring meets itself in a
corner, and each hole goes to the smallest shell around it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
Ring = list[Point]
POLYGONS = "array<array<array<struct<lon:double,lat:double>>>>"


def signed_area(ring: Ring) -> float:
    return 0.5 * math.fsum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def corners(ring: Ring) -> Ring:
    """A ring without its closing corner and without corners that repeat the one before."""
    found = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    while len(found) > 1 and found[0] == found[-1]:
        found.pop()
    return found


def noded(rings: list[Ring]) -> tuple[set[tuple[Point, Point]], bool]:
    """Stretches (lesser end first) that lie on an odd number of edges, none crossing another; and whether an edge had to be cut."""
    edges = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a != b]
    cuts: list[set[Point]] = [set() for _ in edges]
    e = np.array([(*a, *b) for a, b in edges], float).reshape(-1, 4)
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    eps = 1e-12 * max(1.0, float(np.abs(e).max(initial=0.0)))
    for i in range(len(edges)):
        near = np.flatnonzero((low[i + 1 :] <= high[i] + eps).all(axis=1) & (high[i + 1 :] >= low[i] - eps).all(axis=1)) + i + 1
        (ax, ay), (bx, by) = edges[i]
        for j in near.tolist():
            (cx, cy), (dx, dy) = edges[j]
            touching = False
            for k, p, (qx, qy), (rx, ry) in ((i, edges[j][0], *edges[i]), (i, edges[j][1], *edges[i]), (j, edges[i][0], *edges[j]), (j, edges[i][1], *edges[j])):
                length = math.hypot(rx - qx, ry - qy)
                off = ((rx - qx) * (p[1] - qy) - (ry - qy) * (p[0] - qx)) / length
                along = ((rx - qx) * (p[0] - qx) + (ry - qy) * (p[1] - qy)) / length
                if abs(off) <= eps and -eps <= along <= length + eps:
                    touching = True
                    if p != (qx, qy) and p != (rx, ry):
                        cuts[k].add(p)
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if touching or det == 0:
                continue
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
            if 0 < t < 1 and 0 < u < 1:
                p = (ax + t * (bx - ax), ay + t * (by - ay))
                cuts[i].add(p)
                cuts[j].add(p)
    found: set[tuple[Point, Point]] = set()
    for (a, b), inner in zip(edges, cuts):
        ordered = sorted({a, b, *inner}, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for p, q in zip(ordered, ordered[1:]):
            found ^= {(p, q) if p < q else (q, p)}
    return found, any(cuts)


def _directed(stretches: list[tuple[Point, Point]]) -> list[tuple[Point, Point]]:
    """The stretches with the inside on their left."""
    s = np.array([(*a, *b) for a, b in stretches], float)
    out = []
    for a, b in stretches:
        # Count what lies beyond the middle: above it, or to its left if the stretch is upright.
        axis = 0 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 1
        mid, at = (a[axis] + b[axis]) / 2, (a[1 - axis] + b[1 - axis]) / 2
        x1, y1, x2, y2 = s[:, axis], s[:, 1 - axis], s[:, 2 + axis], s[:, 3 - axis]
        over = (x1 <= mid) != (x2 <= mid)
        y = y1[over] + (mid - x1[over]) * (y2 - y1)[over] / (x2 - x1)[over]
        me = (a[axis], a[1 - axis], b[axis], b[1 - axis])
        mine = (x1[over] == me[0]) & (y1[over] == me[1]) & (x2[over] == me[2]) & (y2[over] == me[3])
        beyond = int(((y > at) & ~mine).sum()) % 2 == 1
        forward = b[axis] > a[axis]
        # Above is on the left of a step to the right; to the right is on the right of a step upwards.
        left_is_beyond = forward if axis == 0 else not forward
        out.append((a, b) if left_is_beyond == beyond else (b, a))
    return out


def _walk(directed: list[tuple[Point, Point]]) -> Iterator[Ring]:
    """Closed walks with the inside on the left, none of which meets a corner twice."""
    leaving: dict[Point, list[Point]] = defaultdict(list)
    for a, b in directed:
        leaving[a].append(b)
    unused = set(directed)
    for start in directed:
        if start not in unused:
            continue
        walk, here = [], start
        while here in unused:
            unused.discard(here)
            walk.append(here[0])
            a, b = here
            back = math.atan2(a[1] - b[1], a[0] - b[0])
            # The next one clockwise from the way back bounds the same face.
            turn = lambda q: (back - math.atan2(q[1] - b[1], q[0] - b[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
            ways = [q for q in leaving[b] if (b, q) in unused]
            if not ways:
                break
            here = (b, min(ways, key=turn))
        seen: dict[Point, int] = {}
        ring: Ring = []
        for p in [*walk, walk[0]]:
            if p in seen:
                loop = ring[seen[p] :]
                yield loop
                for q in loop:
                    seen.pop(q, None)
                ring = ring[: len(ring) - len(loop)]
            seen[p] = len(ring)
            ring.append(p)


def _within(ring: Ring, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            odd = not odd
    return odd


def valid_faces(rings: list[Ring]) -> tuple[list[list[Ring]], bool]:
    """Valid polygons (a shell and its holes) that cover what lies in an odd number of rings; and whether the rings were one already.

    Rings that are valid come back as they are.  Else shells run against the clock and holes with it, each from its least
    corner; the largest polygon is first.
    """
    clean = [r for r in (corners(list(map(tuple, ring))) for ring in rings) if len(r) > 2]
    stretches, cut = noded(clean)
    loops = [r for r in _walk(_directed(sorted(stretches))) if len(r) > 2 and signed_area(r) != 0.0] if stretches else []
    shells = sorted((r for r in loops if signed_area(r) > 0), key=signed_area)
    faces = [[s] for s in shells]
    for hole in (r for r in loops if signed_area(r) < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        for face in faces:
            if abs(signed_area(hole)) < signed_area(face[0]) and _within(face[0], x, y):
                face.append(hole)
                break
    faces.sort(key=lambda f: -signed_area(f[0]))
    same = len(clean) == len(rings) and all(len(set(r)) == len(r) for r in clean) and not cut
    was_valid = same and len(faces) == 1 and len(faces[0]) == len(rings) and math.isclose(signed_area(faces[0][0]), abs(signed_area(clean[0])), rel_tol=1e-12)
    least = lambda r: r[r.index(min(r)) :] + r[: r.index(min(r))]
    return ([clean] if was_valid else [[least(r) for r in f] for f in faces]), was_valid


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, valid = [], []
        for polygons in batch.column("polygons").to_pylist():
            faces, ok = [], True
            for rings in polygons or []:
                found, fine = valid_faces([[(p["lon"], p["lat"]) for p in ring] for ring in rings])
                faces += found
                ok &= fine
            shapes.append([[[{"lon": x, "lat": y} for x, y in ring] for ring in face] for face in faces])
            valid.append(ok)
        point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shapes, pa.list_(pa.list_(pa.list_(point)))), pa.array(valid)], names=["key", "polygons", "was_valid"])


def repaired(features: DataFrame, key: str) -> DataFrame:
    """Features (``key``, ``polygons``: a list of polygons, each a list of rings) with valid polygons instead, and ``repaired``.

    A feature of which nothing is left has an empty list: callers treat it as beyond repair.
    """
    kind = dict(features.dtypes)[key]
    found = features.select(F.col(key).alias("key"), F.col("polygons").cast(POLYGONS).alias("polygons")).mapInArrow(_repaired, f"key {kind}, polygons {POLYGONS}, was_valid boolean")
    fixed = found.select(F.col("key").alias("__key"), F.col("polygons"), (~F.col("was_valid")).alias("repaired"))
    return features.drop("polygons").join(fixed, F.col(key) == F.col("__key")).drop("__key")
