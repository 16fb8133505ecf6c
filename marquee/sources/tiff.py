"""GeoTIFF rasters as a Spark data source: one row a tile, one partition a run of tiles.

Reads the first band of the first image of a classic or big TIFF in tiles or strips, uncompressed or deflated, with or
without a predictor.  Comparisons of ``tile_row`` and ``tile_col`` with numbers are pushed: other tiles are not read.
Paths may be of any store that pyarrow opens, as long as executors reach it.

    spark.dataSource.register(Tiff)
    spark.read.format("geotiff").load(path)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from marquee.functions import affine

#: Tiles of a partition.
TILES = 16
SCHEMA = "tile_row int, tile_col int, row0 int, col0 int, height int, width int, `values` array<double>"
#: Fixed values of the format: bytes and letter of its field types, and tag numbers.
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "samples", 278: "strip_rows", 279: "strip_bytes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height",
    324: "tiles", 325: "tile_bytes", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 42113: "nodata",
}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
GEOGRAPHIC_KEY, PROJECTED_KEY, POINT_KEY = 2048, 3072, 1025


class RasterError(ValueError):
    """A raster that cannot be read; the message begins with a code."""


def opened(path: str):
    """A file that can be read from any place."""
    if "://" in path:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path.removeprefix("file:"), "rb")


@dataclass(frozen=True)
class Raster:
    """What a raster's header says."""

    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    kind: str
    samples: int
    compression: int
    predictor: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    gt: affine.Affine
    epsg: int | None
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


def header(path: str) -> Raster:
    with opened(path) as f:
        start = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        magic = struct.unpack_from(f"{order or '<'}H", start, 2)[0] if len(start) >= 8 else 0
        if order is None or magic not in (42, 43):
            raise RasterError(f"RASTER_FORMAT_UNSUPPORTED: {path}")
        big = magic == 43
        at = struct.unpack_from(f"{order}{'Q' if big else 'I'}", start, 8 if big else 4)[0]
        count_size, entry, inline = (8, 20, 8) if big else (2, 12, 4)
        f.seek(at)
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(count_size))[0]
        entries = f.read(n * entry)
        found: dict[str, tuple] = {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", entries, k * entry)
            if tag not in TAGS or kind not in FIELDS:
                continue
            size, letter = FIELDS[kind]
            count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", entries, k * entry + 4)[0]
            raw = entries[k * entry + (12 if big else 8) : (k + 1) * entry]
            if size * count > inline:
                f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", raw[:inline])[0])
                raw = f.read(size * count)
            found[TAGS[tag]] = raw[:count] if letter == "c" else struct.unpack(f"{order}{count * len(letter)}{letter[0]}", raw[: size * count])
    one = lambda name, default=None: found[name][0] if name in found else default
    width, height, samples = one("width"), one("height"), one("samples", 1)
    if width is None or height is None:
        raise RasterError("RASTER_BAND_REQUIRED")
    kind = KINDS.get((one("format", 1), one("bits", 1)))
    if kind is None:
        raise RasterError(f"RASTER_TYPE_UNSUPPORTED: {one('format', 1)}:{one('bits', 1)}")
    if one("compression", 1) not in (1, 8, 32946) or one("predictor", 1) not in (1, 2, 3) or (samples > 1 and one("planar", 1) != 2 and one("predictor", 1) == 3):
        raise RasterError(f"RASTER_COMPRESSION_UNSUPPORTED: {one('compression', 1)}:{one('predictor', 1)}")
    if "matrix" in found:
        m = found["matrix"]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif "scale" in found and "tie" in found:
        (sx, sy, *_), (i, j, _, x, y, *_) = found["scale"], found["tie"]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        raise RasterError("RASTER_GEOTRANSFORM_REQUIRED")
    keys = found.get("keys", ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if geo.get(POINT_KEY) == 2:  # the tie is a pixel's centre
        gt = affine.part(gt, -0.5, -0.5)
    text = found["nodata"].rstrip(b"\0 ").decode() if "nodata" in found else ""
    tiled = "tiles" in found
    return Raster(
        order, width, height, one("tile_width") if tiled else width, one("tile_height") if tiled else min(one("strip_rows", height), height), kind, 1 if one("planar", 1) == 2 else samples, one("compression", 1),
        one("predictor", 1), found["tiles"] if tiled else found["strips"], found["tile_bytes"] if tiled else found["strip_bytes"], gt, geo.get(PROJECTED_KEY) or geo.get(GEOGRAPHIC_KEY), float(text) if text else None,
    )


def decode(raster: Raster, data: bytes, rows: int) -> np.ndarray:
    """A tile's first band as doubles."""
    raw = data if raster.compression == 1 else zlib.decompress(data)
    kind, width, samples = np.dtype(raster.order + raster.kind), raster.tile_width, raster.samples
    n = rows * width * samples
    if raster.predictor == 3:
        # Bytes of equal weight of a row stand together, most significant first, as differences.
        planes = np.cumsum(np.frombuffer(raw, np.uint8, n * kind.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, samples)
    else:
        values = np.frombuffer(raw, kind, n).reshape(rows, width, samples)
        if raster.predictor == 2:
            values = np.cumsum(values.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return values[:, :, 0].astype(np.float64)


class Run(InputPartition):
    def __init__(self, tiles: list[tuple[int, int]]):
        super().__init__(tiles)


class Reader(DataSourceReader):
    def __init__(self, path: str, raster: Raster, run: int):
        self.path, self.raster, self.run = path, raster, run
        self.bounds = {"tile_row": [0, raster.down - 1], "tile_col": [0, raster.across - 1]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            handled = column in self.bounds and isinstance(value, int) and isinstance(f, EqualTo | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual)
            if not handled:
                yield f
                continue
            bound = self.bounds[column]
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                bound[0] = max(bound[0], value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                bound[1] = min(bound[1], value - isinstance(f, LessThan))

    def partitions(self) -> Sequence[InputPartition]:
        (top, bottom), (left, right) = self.bounds["tile_row"], self.bounds["tile_col"]
        tiles = [(r, c) for r in range(top, bottom + 1) for c in range(left, right + 1)]
        return [Run(tiles[k : k + self.run]) for k in range(0, len(tiles), self.run)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition is None:
            return
        r = self.raster
        with opened(self.path) as f:
            for row, col in partition.value:
                at = row * r.across + col
                row0, col0 = row * r.tile_height, col * r.tile_width
                height, width = min(r.tile_height, r.height - row0), min(r.tile_width, r.width - col0)
                if r.sizes[at] == 0:  # a hole in the file
                    values = np.full((height, width), np.nan if r.nodata is None else r.nodata)
                else:
                    f.seek(r.offsets[at])
                    data = f.read(r.sizes[at])
                    strips = r.tile_width == r.width and r.tile_height * r.down != r.height and row == r.down - 1
                    values = decode(r, data, height if strips and len(r.offsets) == r.down and r.across == 1 else r.tile_height)[:height, :width]
                yield row, col, row0, col0, height, width, values.ravel().tolist()


class Tiff(DataSource):
    """Option ``run``: tiles of a partition."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], header(self.options["path"]), int(self.options.get("run", TILES)))


def read(spark: SparkSession, path: str, run: int = TILES) -> DataFrame:
    """The tiles of a raster: their place, their first row and column, and their values row by row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiff)
    return spark.read.format("geotiff").option("run", run).load(path)


def inspect(path: str) -> dict:
    """What a raster is: size, type, reference system, affine map, pixel size, value for no data, and bounds."""
    r = header(path)
    corners = [affine.to_world(r.gt, c, w) for c, w in ((0, 0), (r.width, 0), (0, r.height), (r.width, r.height))]
    xs, ys = zip(*corners)
    return {
        "width": r.width, "height": r.height, "bands": r.samples, "type": np.dtype(r.kind).name, "epsg": r.epsg, "geotransform": list(r.gt), "pixel_size": [abs(r.gt[1]), abs(r.gt[5])],
        "rotated": abs(r.gt[2]) > 1e-12 or abs(r.gt[4]) > 1e-12, "nodata": r.nodata, "bounds": [min(xs), min(ys), max(xs), max(ys)], "tile": [r.tile_width, r.tile_height],
    }
