"""Windows of tiled rasters around sites, and the population that cheapest walks over a friction grid reach.

A raster is a frame of tiles (tile_row, tile_col, row0, col0, height, width, values row by row), as ``sources.tiff``
reads it or ``tiled`` makes it from cells, and a ``Grid``.  A window joins the tiles it touches by their numbers; only
its own stretch of each row is kept.  A window's size follows from the metres it reaches and not from the data.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import affine, geo
from marquee.operators.spatial import tasks


@dataclass(frozen=True)
class Grid:
    """A raster's affine map, size, tile size, and the value that stands for none."""

    gt: affine.Affine
    width: int
    height: int
    tile_width: int = 256
    tile_height: int = 256
    nodata: float | None = None


def tiled(cells: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells (row, col, value; those missing are null) as tiles, for each of the keys' values."""
    place = [F.floor(F.col(c) / s).cast("int").alias(n) for c, s, n in (("row", grid.tile_height, "tile_row"), ("col", grid.tile_width, "tile_col"))]
    placed = cells.select(*keys, *place, "row", "col", "value")
    row0, col0 = F.col("tile_row") * grid.tile_height, F.col("tile_col") * grid.tile_width
    height, width = F.least(F.lit(grid.tile_height), grid.height - row0).cast("int"), F.least(F.lit(grid.tile_width), grid.width - col0).cast("int")
    at = ((F.col("row") - row0) * width + F.col("col") - col0).cast("int")
    packed = placed.groupBy(*keys, "tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct(at, F.col("value").cast("double")))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), height * width - 1), lambda k: F.try_element_at("m", k))
    return packed.select(*keys, "tile_row", "tile_col", row0.cast("int").alias("row0"), col0.cast("int").alias("col0"), height.alias("height"), width.alias("width"), values.alias("values"))


#: Rasters of up to so many cells (and keys) go to all tasks; the tiles of larger ones are joined by their numbers.
SMALL = 2**20


def windows(sites: DataFrame, grid: Grid, metres: float) -> DataFrame:
    """Sites or positions (lon, lat) with the columns and rows of the raster around them, and whether the raster holds all of them.

    The window holds the circle's eight points of the compass with two pixels to spare; ``inside`` says whether any of it
    lies in the raster.
    """
    ring = F.transform(F.array(*[F.lit(float(b)) for b in range(0, 360, 45)]), lambda b: geo.destination(F.col("lon"), F.col("lat"), b, F.lit(float(metres))))
    ring = F.concat(ring, F.array(F.struct("lon", "lat")))

    def pixel(p: Column) -> Column:
        col, row = affine.to_pixel(grid.gt, p["lon"], p["lat"])
        return F.struct(col.alias("col"), row.alias("row"))

    found = sites.withColumn("ring", F.transform(ring, pixel))
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    raw = {f"{a}0": F.floor(of(F.array_min, c)) - 2 for a, c in (("x", "col"), ("y", "row"))} | {f"{a}1": F.ceil(of(F.array_max, c)) + 2 for a, c in (("x", "col"), ("y", "row"))}
    found = found.withColumns({k: v.cast("int") for k, v in raw.items()}).drop("ring")
    whole = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= grid.width) & (F.col("y1") <= grid.height)
    found = found.withColumn("covered", whole)
    cut = {"x0": F.greatest("x0", F.lit(0)), "y0": F.greatest("y0", F.lit(0)), "x1": F.least("x1", F.lit(grid.width)), "y1": F.least("y1", F.lit(grid.height))}
    return found.withColumns(cut).withColumn("inside", (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def window_rows(found: DataFrame, tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = (), of: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """For each window and tile it touches, one row a raster row: the columns ``of`` the window, the tiles' keys, row, col (of the first value) and values."""
    span = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor((F.col(b) - 1) / size).cast("int")))
    asked = found.where("inside").withColumn("tile_row", span("y0", "y1", grid.tile_height)).withColumn("tile_col", span("x0", "x1", grid.tile_width))
    met = asked.select(*of, "x0", "y0", "x1", "y1", "tile_row", "tile_col").join(F.broadcast(tiles) if grid.width * grid.height <= SMALL else tiles, ["tile_row", "tile_col"])
    first, last = F.greatest("y0", "row0"), F.least(F.col("y1"), F.col("row0") + F.col("height")) - 1
    left, right = F.greatest("x0", "col0"), F.least(F.col("x1"), F.col("col0") + F.col("width"))
    rows = met.select(*of, *keys, "row0", "col0", "width", "values", left.alias("col"), right.alias("right"), F.explode(F.sequence(first, last)).alias("row"))
    start = (F.col("row") - F.col("row0")) * F.col("width") + F.col("col") - F.col("col0") + 1
    return rows.select(*of, *keys, "row", "col", F.slice("values", start, F.col("right") - F.col("col")).alias("values"))


def population_within(sites: DataFrame, tiles: DataFrame, grid: Grid, radii: list[int]) -> DataFrame:
    """Per site and radius the population of the cells whose centres lie within it, cells with and without a value, and coverage.

    Sites at one position share its sums.  Rows are dealt to tasks by position once; the rest needs no further shuffle.
    """
    ordered = sorted(set(radii))
    dealt = sites.select("site_id", "lon", "lat").repartition(tasks(sites.sparkSession), "lon", "lat")
    # Windows are opened for aggregated columns, so that the test on them is not moved before the dealing, where few tasks read.
    spots = dealt.groupBy(F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat")).agg(F.any_value("lon").alias("lon"), F.any_value("lat").alias("lat"))
    cells = window_rows(windows(spots, grid, float(ordered[-1])), tiles, grid, of=("at_lon", "at_lat")).select("at_lon", "at_lat", "row", "col", F.posexplode("values").alias("k", "value"))
    to_lon, to_lat = affine.to_world(grid.gt, F.col("col") + F.col("k") + 0.5, F.col("row") + 0.5)
    near = cells.select("at_lon", "at_lat", geo.haversine(to_lon, to_lat, F.col("at_lon"), F.col("at_lat")).alias("distance"), value_of(grid).alias("value"))
    # A cell counts once, at the smallest radius that holds it; larger radii are sums.
    least = F.coalesce(*[F.when(F.col("distance") <= r, F.lit(r)) for r in ordered])
    once = near.select("at_lon", "at_lat", "value", least.alias("least")).where(F.col("least").isNotNull()).groupBy("at_lon", "at_lat", "least").agg(F.sum("value").alias("p"), F.count("value").alias("v"), F.count(F.lit(1)).alias("n"))
    summed = once.groupBy(F.col("at_lon").alias("lon"), F.col("at_lat").alias("lat")).agg(F.collect_list(F.struct("least", "p", "v", "n")).alias("s"))
    every = windows(dealt, grid, float(ordered[-1])).join(summed, ["lon", "lat"], "left").select("site_id", "covered", "inside", "s", F.explode(F.array(*[F.lit(r) for r in ordered])).alias("radius"))
    upto = F.filter("s", lambda x: x["least"] <= F.col("radius"))
    total = lambda c, zero: F.coalesce(F.aggregate(upto, F.lit(zero).cast("double" if c == "p" else "long"), lambda a, x: a + F.coalesce(x[c], F.lit(0))), F.lit(zero))
    found = every.select("site_id", "radius", total("p", 0.0).alias("population"), total("n", 0).alias("n_candidates"), total("v", 0).alias("n_valid"), coverage().alias("status"))
    return found.select("site_id", "radius", "population", "n_candidates", "n_valid", (F.col("n_candidates") - F.col("n_valid")).alias("n_nodata"), "status")


def value_of(grid: Grid) -> Column:
    """A population value, or null where there is none."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.when(ok if grid.nodata is None else ok & (v != grid.nodata), v)


def coverage() -> Column:
    return F.when(F.col("covered"), "complete").when(F.col("inside"), "partial_source_coverage").otherwise("outside_source_coverage")


def cost_surface(friction: np.ndarray, start: tuple[int, int], most: float, step_x: float, step_y: float) -> np.ndarray:
    """Minutes from ``start`` to each cell by eight-neighbour moves; friction is minutes a unit of the steps, not positive or nan blocks.

    A move costs the mean friction of its two cells times its length, so it is the same both ways.
    """
    cost = np.full(friction.shape, np.inf)
    ok = np.isfinite(friction) & (friction > 0)
    if not (0 <= start[0] < friction.shape[0] and 0 <= start[1] < friction.shape[1] and ok[start]):
        return cost
    cost[start] = 0.0
    queue = [(0.0, *start)]
    rows, cols = friction.shape
    moves = [(a, b, math.hypot(a * step_y, b * step_x)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    while queue:
        d, r, c = heapq.heappop(queue)
        if d > cost[r, c]:
            continue
        for dr, dc, length in moves:
            x, y = r + dr, c + dc
            if 0 <= x < rows and 0 <= y < cols and ok[x, y]:
                e = d + length * (friction[r, c] + friction[x, y]) / 2
                if e < cost[x, y] and e <= most:
                    cost[x, y] = e
                    heapq.heappush(queue, (e, x, y))
    return cost


_REACH = "lon double, lat double, mode string, minutes double, population double, n_candidates long, n_valid long, n_nodata long, n_reachable long, n_unavailable long, n_friction_cells long, farthest_minutes double, status string"
#: So many positions are one group, which gets the tiles that their windows touch.
GROUP = 200


def _dense(tiles: pd.DataFrame, y0: int, x0: int, y1: int, x1: int, nodata: float | None) -> np.ndarray:
    """The values of tiles from row y0 and column x0 on; nan where there is none."""
    found = np.full((y1 - y0, x1 - x0), np.nan)
    for r, c, h, w, values in zip(tiles["row0"].astype(int), tiles["col0"].astype(int), tiles["height"].astype(int), tiles["width"].astype(int), tiles["values"]):
        v = np.array(values, float).reshape(h, w)
        top, left, low, right = max(r, y0), max(c, x0), min(r + h, y1), min(c + w, x1)
        if top < low and left < right:
            found[top - y0 : low - y0, left - x0 : right - x0] = v[top - r : low - r, left - c : right - c]
    return found if nodata is None else np.where(found == nodata, np.nan, found)


def accessible_population(sites: DataFrame, friction: DataFrame, friction_grid: Grid, population: DataFrame, population_grid: Grid, modes: list[str], minutes: list[float], metres: float) -> DataFrame:
    """Population that each site reaches within each number of minutes, by mode.

    ``friction`` has tiles by ``mode``, ``population`` tiles.  Walks go over the friction window; a population cell has the
    cost of the friction cell in which its centre lies.  A site outside either raster, or on a blocked cell, reaches no one
    and says so in ``status``; a walk that comes to the window's edge within the largest number of minutes is marked.

    Positions whose windows begin in the same friction tile are dealt to groups of about GROUP, and a group gets its tiles
    once.  Its area follows from the tile's size and the metres, its number of positions from the dealing.  Walks from one
    cell over one window are the same.
    """
    top, step_x, step_y = max(minutes), math.hypot(friction_grid.gt[1], friction_grid.gt[4]), math.hypot(friction_grid.gt[2], friction_grid.gt[5])
    parts = tasks(sites.sparkSession)
    bounds = ("x0", "y0", "x1", "y1")
    # As in population_within, windows are opened after the dealing.
    spots = sites.select("lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").repartition(parts, "lon", "lat").groupBy(F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat")).agg(F.any_value("lon").alias("lon"), F.any_value("lat").alias("lat"))
    spots = windows(spots, friction_grid, metres).select("lon", "lat", *[F.col(c).alias(f"f{c}") for c in bounds], F.col("inside").alias("finside"))
    spots = windows(spots, population_grid, metres).where("finside AND inside").select("lon", "lat", *[f"f{c}" for c in bounds], *[F.col(c).alias(f"p{c}") for c in bounds], "covered")
    block = [F.floor(F.col(c) / s).cast("int").alias(n) for c, s, n in (("fy0", friction_grid.tile_height, "block_row"), ("fx0", friction_grid.tile_width, "block_col"))]
    keys = ["block_row", "block_col", "part"]
    placed = spots.withColumns({"block_row": block[0], "block_col": block[1]})
    sizes = placed.groupBy("block_row", "block_col").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("n"))
    dealt = placed.join(sizes, ["block_row", "block_col"]).withColumn("part", F.pmod(F.xxhash64("lon", "lat"), F.col("n"))).drop("n").repartition(parts, *keys)
    # The groups' own names for their keys, since both sides of the grouping come from the same rows.
    owners = [f"of_{k}" for k in keys]
    area = dealt.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, owners)]).agg(*[f(k + c).alias(k + c) for k in "fp" for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])

    def touched(kind: str, tiles: DataFrame, grid: Grid, mode: Column) -> DataFrame:
        span = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(kind + a) / size).cast("int"), F.floor((F.col(kind + b) - 1) / size).cast("int")))
        asked = area.withColumn("tile_row", span("y0", "y1", grid.tile_height)).withColumn("tile_col", span("x0", "x1", grid.tile_width))
        met = asked.join(F.broadcast(tiles) if grid.width * grid.height <= SMALL else tiles, ["tile_row", "tile_col"])
        return met.select(*owners, F.lit(kind).alias("kind"), mode.alias("mode"), "row0", "col0", "height", "width", "values")

    grounds = touched("f", friction, friction_grid, F.col("mode")).union(touched("p", population, population_grid, F.lit(None).cast("string"))).repartition(parts, *owners)
    names = [c.strip().split(" ")[0] for c in _REACH.split(",")]

    def group(places: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        out, walks = [], {}
        if not len(places):
            return pd.DataFrame(columns=names)
        fx, fy, px, py = (int(places[c].min()) for c in ("fx0", "fy0", "px0", "py0"))
        fx_, fy_, px_, py_ = (int(places[c].max()) for c in ("fx1", "fy1", "px1", "py1"))
        ways = {m: _dense(tiles[(tiles["kind"] == "f") & (tiles["mode"] == m)], fy, fx, fy_, fx_, friction_grid.nodata) for m in modes}
        lived = _dense(tiles[tiles["kind"] == "p"], py, px, py_, px_, population_grid.nodata)
        rows, cols = np.indices(lived.shape, dtype=float)
        col, row = affine.to_pixel(friction_grid.gt, *affine.to_world(population_grid.gt, cols + px + 0.5, rows + py + 0.5))
        cell_row, cell_col = np.floor(row).astype(int), np.floor(col).astype(int)
        for s in places.itertuples(index=False):
            col, row = affine.to_pixel(friction_grid.gt, float(s.lon), float(s.lat))
            start = (math.floor(row) - s.fy0, math.floor(col) - s.fx0)
            here = (slice(s.py0 - py, s.py1 - py), slice(s.px0 - px, s.px1 - px))
            people, r, c = lived[here], cell_row[here] - s.fy0, cell_col[here] - s.fx0
            valid = np.isfinite(people) & (people >= 0)
            n_valid = int(valid.sum())
            for mode in modes:
                walk = (mode, start, s.fx0, s.fy0, s.fx1, s.fy1)
                if walk not in walks:
                    walks[walk] = cost_surface(ways[mode][s.fy0 - fy : s.fy1 - fy, s.fx0 - fx : s.fx1 - fx], start, top, step_x, step_y)
                cost = walks[walk]
                warped = np.full(people.shape, np.inf)
                if np.isfinite(cost).any():
                    edge = np.concatenate([cost[0], cost[-1], cost[:, 0], cost[:, -1]])
                    status = "complete" if s.covered and not np.isfinite(edge).any() else "partial_or_truncated"
                    within = (r >= 0) & (c >= 0) & (r < cost.shape[0]) & (c < cost.shape[1])
                    warped[within] = cost[r[within], c[within]]
                else:
                    status = "friction_cell_unavailable"
                known = valid & np.isfinite(warped)
                for m in sorted(set(minutes)):
                    reached, paid = known & (warped <= m), cost[cost <= m]
                    out.append((s.lon, s.lat, mode, float(m), float(people[reached].sum()), people.size, n_valid, people.size - n_valid, int(reached.sum()), n_valid - int(known.sum()), paid.size, float(paid.max(initial=0.0)), status))
        return pd.DataFrame(out, columns=names)

    found = dealt.groupBy(*keys).cogroup(grounds.groupBy(*owners)).applyInPandas(group, _REACH)
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    every = sites.select("site_id", "lon", "lat", each(modes).alias("mode")).withColumn("minutes", each([float(m) for m in sorted(set(minutes))]))
    shown = {"population": 0.0, **dict.fromkeys(("n_candidates", "n_valid", "n_nodata", "n_reachable", "n_unavailable", "n_friction_cells"), 0), "farthest_minutes": 0.0, "status": "outside_source_coverage"}
    return every.join(found, ["lon", "lat", "mode", "minutes"], "left").select("site_id", "mode", "minutes", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in shown.items()])
