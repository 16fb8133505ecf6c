"""GeoPackage layers as a Spark data source.

A layer is read in ranges of its row ids, one a partition.  Comparisons of ``xmin``, ``xmax``, ``ymin`` and ``ymax``
with numbers are pushed into the file's own R-tree, so rows outside a box are not decoded; the tree rounds boxes
outwards, so Spark still applies the comparisons itself.  The file must be on a path that executors share.

    spark.dataSource.register(GeoPackage)
    spark.read.format("geopackage").option("layer", "extents").load(path)
"""

from __future__ import annotations

import math
import sqlite3
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from marquee.operators import repair

#: Row ids of a partition.
ROWS = 50_000
#: Bytes of an envelope by its kind, and Spark types by declared type.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
TYPES = {"BOOLEAN": "boolean", "TINYINT": "long", "SMALLINT": "long", "MEDIUMINT": "long", "INT": "long", "INTEGER": "long", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "BLOB": "binary"}
#: Half the width of the plane of EPSG 3857.
MERCATOR = 20_037_508.342789244
BOX = ("xmin", "ymin", "xmax", "ymax")


class LayerError(ValueError):
    """A file or layer that cannot be read; the message begins with a code."""


def connect(path: str) -> sqlite3.Connection:
    name = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    try:
        db = sqlite3.connect(f"file:{name}?mode=ro", uri=True)
        db.execute("SELECT 1 FROM gpkg_contents LIMIT 1")
    except sqlite3.Error as e:
        raise LayerError(f"LAYER_FILE_OPEN_FAILED: {path}: {e}") from e
    return db


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Layer:
    name: str
    key: str
    geometry: str
    geometry_type: str
    epsg: int
    columns: tuple[tuple[str, str], ...]
    tree: str | None


def layer_of(db: sqlite3.Connection, wanted: str | None) -> Layer:
    """The layer by its name, or the only one with polygons."""
    rows = db.execute("SELECT g.table_name, g.column_name, g.geometry_type_name, coalesce(s.organization_coordsys_id, g.srs_id) FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s USING (srs_id)").fetchall()
    if wanted:
        rows = [r for r in rows if r[0] == wanted]
        if not rows:
            raise LayerError(f"LAYER_NOT_FOUND: {wanted}")
    else:
        rows = [r for r in rows if "POLYGON" in r[2].upper()]
        if not rows:
            raise LayerError("POLYGON_LAYER_REQUIRED")
        if len(rows) > 1:
            raise LayerError("LAYER_REQUIRED_FOR_MULTI_LAYER_SOURCE")
    name, geometry, kind, epsg = rows[0]
    if epsg not in (4326, 3857):
        raise LayerError(f"LAYER_CRS_UNSUPPORTED: {epsg}")
    info = db.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
    keys = [c[1] for c in info if c[5]]
    tree = f"rtree_{name}_{geometry}"
    has_tree = db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (tree,)).fetchone()[0]
    columns = tuple((c[1], TYPES.get(c[2].split("(")[0].upper(), "string")) for c in info if c[1] not in (geometry, *keys[:1]))
    return Layer(name, keys[0] if keys else "rowid", geometry, kind, int(epsg), columns, tree if has_tree else None)


def to_degrees(x: float, y: float, epsg: int) -> tuple[float, float]:
    if epsg == 3857:
        return 180.0 * x / MERCATOR, math.degrees(2 * math.atan(math.exp(math.pi * y / MERCATOR)) - math.pi / 2)
    return x, y


def decode(blob: bytes | None, epsg: int) -> list | None:
    """Polygons (lists of rings of lon/lat) of a geometry; None for a null or empty one or one of another kind."""
    if blob is None or blob[:2] != b"GP":
        return None
    flags = blob[3]
    if flags & 0x10:
        return None
    at = 8 + ENVELOPE[(flags >> 1) & 7]

    def number(fmt: str, order: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(order + fmt, blob, at)
        at += struct.calcsize(order + fmt)
        return found

    def shape() -> list:
        (little,) = number("B", "<")
        order = "<" if little else ">"
        (code,) = number("I", order)
        dims = 2 + (code // 1000 % 4 in (1, 2)) + 2 * (code // 1000 % 4 == 3) if code < 0x20000000 else 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code % 1000 if code < 0x20000000 else code & 0xFF
        if kind == 3:
            rings = []
            for _ in range(number("I", order)[0]):
                n = number("I", order)[0]
                flat = number(f"{n * dims}d", order)
                rings.append([to_degrees(flat[k], flat[k + 1], epsg) for k in range(0, n * dims, dims)])
            return [rings]
        if kind in (6, 7):
            return [p for _ in range(number("I", order)[0]) for p in shape()]
        raise LayerError(f"POLYGON_GEOMETRY_REQUIRED: {kind}")

    return shape() or None


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class Reader(DataSourceReader):
    def __init__(self, path: str, layer: Layer, rows: int):
        self.path, self.layer, self.rows = path, layer, rows
        self.conditions: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {LessThan: "<=", LessThanOrEqual: "<=", GreaterThan: ">=", GreaterThanOrEqual: ">="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in BOX and isinstance(getattr(f, "value", None), int | float) and self.layer.tree and self.layer.epsg == 4326:
                for sign in ("<=", ">=") if isinstance(f, EqualTo) else [signs[type(f)]] if type(f) in signs else []:
                    self.conditions.append((column, sign, float(f.value)))
            # The tree's boxes are rounded outwards, so Spark tests again.
            yield f

    def where(self) -> tuple[str, list[float]]:
        """A box's least bounds are rounded down and its greatest up, so only tests that stay true outwards can use the tree."""
        usable = [(c, s, v) for c, s, v in self.conditions if (s == "<=") == c.endswith("min")]
        if not usable:
            return "", []
        names = {"xmin": "minx", "xmax": "maxx", "ymin": "miny", "ymax": "maxy"}
        tests = " AND ".join(f"{names[c]} {s} ?" for c, s, _ in usable)
        return f" AND {quoted(self.layer.key)} IN (SELECT id FROM {quoted(self.layer.tree)} WHERE {tests})", [v for *_, v in usable]

    def partitions(self) -> Sequence[InputPartition]:
        db = connect(self.path)
        first, last = db.execute(f"SELECT min({quoted(self.layer.key)}), max({quoted(self.layer.key)}) FROM {quoted(self.layer.name)}").fetchone()
        db.close()
        return [] if first is None else [Range(k, min(k + self.rows - 1, last)) for k in range(first, last + 1, self.rows)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:
            return
        db, layer = connect(self.path), self.layer
        names = ", ".join(quoted(c) for c, _ in layer.columns)
        extra, values = self.where()
        query = f"SELECT {quoted(layer.key)}, {quoted(layer.geometry)}{', ' + names if names else ''} FROM {quoted(layer.name)} WHERE {quoted(layer.key)} BETWEEN ? AND ?{extra} ORDER BY 1"
        kinds = [k for _, k in layer.columns]
        for key, blob, *rest in db.execute(query, [*partition.value, *values]):
            shapes = decode(blob, layer.epsg)
            xs, ys = ([p[k] for s in shapes or [] for r in s for p in r] for k in (0, 1))
            box = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
            cells = [None if v is None else bool(v) if k == "boolean" else float(v) if k == "double" else str(v) if k == "string" else v for v, k in zip(rest, kinds)]
            yield (key, shapes, *box, *cells)
        db.close()


class GeoPackage(DataSource):
    """Options: ``layer`` (needed if several have polygons) and ``rows`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self) -> Layer:
        db = connect(self.options["path"])
        try:
            return layer_of(db, self.options.get("layer"))
        finally:
            db.close()

    def schema(self) -> str:
        layer = self._layer()
        taken = {"fid", "polygons", *BOX}
        clash = [c for c, _ in layer.columns if c.lower() in taken]
        if clash:
            raise LayerError(f"LAYER_COLUMN_CLASH: {clash[0]}")
        return ", ".join([f"fid long, polygons {repair.POLYGONS}", *(f"{c} double" for c in BOX), *(f"`{c}` {k}" for c, k in layer.columns)])

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._layer(), int(self.options.get("rows", ROWS)))


def read(spark: SparkSession, path: str, layer: str | None = None, rows: int = ROWS) -> DataFrame:
    """A layer's features: fid, polygons, their box, and the layer's columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage").option("rows", rows)
    return (reader.option("layer", layer) if layer else reader).load(path)


def inspect(path: str, layer: str | None = None) -> dict:
    """What a layer is: its name, geometry, reference system, fields, features and bounds."""
    db = connect(path)
    found = layer_of(db, layer)
    bounds = db.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents WHERE table_name = ?", (found.name,)).fetchone()
    count = db.execute(f"SELECT count(*) FROM {quoted(found.name)}").fetchone()[0]
    db.close()
    low, high = to_degrees(*bounds[:2], found.epsg), to_degrees(*bounds[2:], found.epsg)
    return {"layer": found.name, "features": count, "geometry_type": found.geometry_type, "epsg": found.epsg, "fields": [{"name": c, "type": k} for c, k in found.columns], "bounds": list(bounds), "bounds_wgs84": [*low, *high]}


def export(features: DataFrame, path: str) -> None:
    """One JSON line a feature, with its columns, valid polygons and whether they had to be repaired; a feature beyond repair is an error."""
    fixed = repair.repaired(features, "fid")
    broken = F.raise_error(F.concat(F.lit("INVALID_GEOMETRY_UNREPAIRABLE: "), F.col("fid").cast("string"))).cast(repair.POLYGONS)
    fixed = fixed.withColumn("polygons", F.when(F.size("polygons") > 0, F.col("polygons")).otherwise(broken))
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("polygons", lambda s: F.transform(s, ring)).alias("coordinates"))
    properties = F.struct(*[c for c in features.columns if c not in ("fid", "polygons", *BOX)]) if len(features.columns) > 6 else F.create_map().cast("map<string,string>")
    line = F.to_json(F.struct(F.col("fid").cast("string").alias("id"), properties.alias("properties"), geometry.alias("geometry"), "repaired"), {"ignoreNullFields": "false"})
    fixed.select(line.alias("value")).write.text(path)
