"""Readers for the file kinds the warehouse takes in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV or, by its ending, TSV, with a header.  A malformed row is an error if a schema is given; without one all columns are text."""
    if path.lower().endswith(".xls"):
        raise ValueError("UNSUPPORTED_SPREADSHEET")
    reader = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def quarantine_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines with their file."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("row").isNull() | F.col("row.__bad").isNotNull()
    names = [f.name for f in StructType.fromDDL(schema).fields]
    return parsed.where(~bad).select(*[F.col(f"row.{n}").alias(n) for n in names]), parsed.where(bad).select("file", "value")


FEATURE = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection or of single Feature files; properties as text, coordinates as JSON text."""
    whole = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", f"type string, features array<struct<{_struct(FEATURE)}>>")
    single = F.from_json("value", FEATURE)
    rows = whole.select(F.when(listed["type"] == "FeatureCollection", listed["features"]).otherwise(F.array(single)).alias("f"))
    return rows.select(F.inline("f")).where("type = 'Feature'")


def read_geojson_sequence(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line, with or without the record separator; a repeated id is an error when the rows are read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x1e", "").alias("value")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", FEATURE, {"mode": "FAILFAST"}).alias("f")).select("f.*")


def _struct(ddl: str) -> str:
    """``a string, b int`` as ``a:string,b:int`` for use inside struct<>; types of this module only."""
    return re.sub(r"(\w+) (string|map<string,string>|struct<[^>]*>)", r"\1:\2", ddl).replace(", ", ",")


def read_airports(spark: SparkSession, path: str, country: str = "NG") -> DataFrame:
    """Airport references of one country; ids are checked by ``heads.duplicates``."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.where(F.upper(F.trim("iso_country")) == country)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(data: bytes):
    """(sheet, row number from 1, cells) of an .xlsx file; formulas give their stored result, gaps are None."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = targets[sheet.get(_REL)]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield sheet.get("name"), int(row.get("r")), cells
                row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of .xlsx files as ``file, sheet, row, cells``; a file is one task's work, read through Spark."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = list(workbook_rows(data.as_py()))
                sheet, number, cells = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(sheet, pa.string()), pa.array(number, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, sheet string, row int, cells array<string>")
