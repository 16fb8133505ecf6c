"""Token-id files: concatenated ids, with document boundaries in Elias-Fano code.

A file holds the ids of consecutive documents (ascending ``doc_id``) as 16-bit
integers and two Elias-Fano sequences: where each document ends, and the
documents' ids less the smallest.  Every reader, ``read`` included, finds a document's
ids from the select structures without a 64-bit table of offsets.

Documents are dealt out by ranges of ``doc_id`` and sorted within a task, which
writes files of bounded size one after the other.  Each attempt of a task writes
under names of its own and returns them; only files named in the manifest, which
Spark commits, belong to the data set, so lost executors and repeated attempts
leave nothing that is read.

Defined cases: a null text is empty and still gets the end id; rows without an
id come first; rows with equal or null ids follow each other in order of their first
PREFIX characters, then of a hash of the text, so that many of them are dealt to
several tasks too; a text of any length stays in one file; other columns, whatever
their names, are not read; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm import elias_fano
from marquee.llm.scratch import materialize, new_path
from marquee.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: A file is closed once it has this many ids; one document is never split.
IDS_PER_FILE = 8_000_000
PREFIX = 32

_MAGIC = b"MQTOKEN1"
#: Documents, documents without an id (they come first), smallest id, token ids, place of the ids.
_HEAD = struct.Struct("<8sQQqQQ")


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one file; ``ids`` are 16-bit little-endian, end id included."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = elias_fano.encode(np.cumsum([len(b) // 2 for b in ids]))
    names = elias_fano.encode((known - base).astype(np.uint64))
    at = _HEAD.size + len(ends) + len(names)
    pad = -at % 8
    head = _HEAD.pack(_MAGIC, len(ids), len(ids) - len(known), base, sum(map(len, ids)) // 2, at + pad)
    return b"".join([head, ends, names, b"\0" * pad, *ids])


class TokenFile:
    """Reads ``pack``'s bytes."""

    def __init__(self, data: bytes | memoryview):
        magic, self.n_docs, self.n_nameless, self.base, self.n_ids, at = _HEAD.unpack_from(data, 0)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.ends = elias_fano.EliasFano(data, _HEAD.size)
        self.names = elias_fano.EliasFano(data, self.ends.end)
        self.ids = np.frombuffer(data, "<u2", self.n_ids, at)

    def __len__(self) -> int:
        return self.n_docs

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_nameless else self.base + self.names[i - self.n_nameless]

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends[i]]

    def doc_ids(self) -> list[int | None]:
        return [self.doc_id(i) for i in range(self.n_docs)]


def _store(path: str):
    from pyarrow import fs

    # Hadoop's name of the store that pyarrow calls s3.
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _writer(folder: str, vocabulary: str, end_id: int, per_file: int):
    end = np.array([end_id], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        attempt, seq = uuid.uuid4().hex, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"part-{part:06d}-{seq:06d}-{attempt}.mqt"
            store, at = _store(folder)
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(pack(doc_ids, ids))
            row = [[part], [seq], [name], [len(ids)], [size]]
            doc_ids.clear()
            ids.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "name", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary, False).encode(batch.column("text").to_pylist())):
                doc_ids.append(doc_id)
                ids.append(found + end)
                size += len(ids[-1]) // 2
                if size >= per_file:
                    yield close()
        if ids:
            yield close()

    return write


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode ``docs`` into files under ``folder``; the manifest, a row per file: name, n_docs, n_ids and start, the ids before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.substring("text", 1, PREFIX), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = rows.mapInArrow(_writer(folder, vocabulary, end_id, per_file), "part int, seq int, name string, n_docs long, n_ids long")
    manifest = materialize(files, "manifest")
    # One row per file of IDS_PER_FILE ids: small enough for one ordered running sum.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(manifest.select("name", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")), "manifest")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{at}/{name}") as file:
                    data = TokenFile(file.read_buffer())
                ends = [data.ends[i] for i in range(len(data))]
                starts = [0, *ends[:-1]]
                crcs = [zlib.crc32(data.ids[a:b].astype("<u4")) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (data.doc_ids(), [start + a for a in starts], [b - a for a, b in zip(starts, ends)], crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the manifest's files."""
    files = manifest.select("name", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return files.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
