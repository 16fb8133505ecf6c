"""Packing documents into sequences by patterns fitted with non-negative least squares.

Documents are tokenized and cut into pieces of at most the sequence length.  The
histogram of piece lengths (at most one count per length, so its size does not
grow with the corpus) goes to the driver.  There, patterns of up to three lengths
that fill a sequence exactly get repeat counts by non-negative least squares
against the histogram; counts are rounded down within what the histogram has,
and what remains is packed by best fit decreasing, again in counts.
The plan is a table of runs: "pieces of this length with ranks a to b go to
sequences s, s+1, ... at this offset".  Tasks look their pieces up in it.

A piece's rank among those of its length is its count within its task plus a
running sum over tasks, so no length's pieces meet in one task.

Defined cases: a null or empty text is one piece, the end id; rows with equal or
null ids are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.scratch import materialize
from marquee.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 0
LENGTH = 2048
STEPS = 200


@dataclass
class Plan:
    """Runs sorted by length and first rank; patterns and how often each is used."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    patterns: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def exact_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of up to three lengths of ``present`` with sum ``size``, padded by 0, largest first."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    found = []
    if has[size]:
        found.append(np.array([[size, 0, 0]]))
    a = present[(present * 2 >= size) & (present < size)]
    a = a[has[size - a]]
    found.append(np.stack([a, size - a, np.zeros_like(a)], axis=1))
    for x in present[present * 3 >= size]:
        y = present[(present <= x) & (2 * present >= size - x) & (present < size - x)]
        y = y[has[size - x - y]]
        found.append(np.stack([np.full_like(y, x), y, size - x - y], axis=1))
    return np.concatenate(found).astype(np.int64)


def fit(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts whose summed patterns come nearest to the histogram, by scaled projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    per_length = np.maximum(np.bincount(patterns[used], minlength=len(histogram)), 1)
    columns = used.sum(axis=1)
    x = np.zeros(len(patterns))
    target = histogram.astype(float)
    target[0] = 0
    for _ in range(steps):
        have = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=len(histogram))
        miss = (target - have) / per_length
        miss[0] = 0
        x = np.maximum(0, x + 1.5 * miss[patterns].sum(axis=1) / columns)
    return x


def sparse_fit(patterns: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and counts after keeping the most used patterns, a few per length, and fitting these again.

    The histogram has far fewer equations than there are patterns; with few
    patterns the same fit needs larger counts, which rounding hardly changes.
    """
    x = fit(patterns, histogram)
    for per_length in (16, 4):
        keep = np.argsort(-x, kind="stable")[: per_length * np.count_nonzero(histogram)]
        patterns = patterns[np.sort(keep)]
        x = fit(patterns, histogram)
    return patterns, x


def rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Counts rounded down, largest first, within ``left``, which is reduced by what they use."""
    plan = []
    whole = np.floor(x + 1e-9).astype(np.int64)
    at = np.flatnonzero(whole)
    at = at[np.argsort(-whole[at], kind="stable")]
    for p, n in zip(patterns[at].tolist(), whole[at].tolist()):
        p = [v for v in p if v]
        n = min(n, *(left[v] // p.count(v) for v in p))
        if n > 0:
            for v in p:
                left[v] -= n
            plan.append((tuple(p), int(n)))
    return plan


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing in counts: equal bins stay together."""
    room = np.zeros(size + 1, np.int64)
    bins: dict[int, list[list]] = {}

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        room[space] += n
        bins.setdefault(space, []).append([pattern, n])

    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            fits = np.flatnonzero(room[v:])
            if not len(fits):
                each = size // v
                if n >= each:
                    put(size - each * v, (v,) * each, n // each)
                if n % each:
                    put(size - (n % each) * v, (v,) * (n % each), 1)
                break
            space = int(fits[0]) + v
            pattern, have = bins[space].pop()
            k = min(n, have)
            if have > k:
                bins[space].append([pattern, have - k])
            room[space] -= k
            n -= k
            put(space - v, (*pattern, v), k)
    return [(tuple(p), n) for found in bins.values() for p, n in found if n]


def make_plan(histogram: np.ndarray, size: int = LENGTH) -> Plan:
    """``histogram`` counts pieces by length, 0 to ``size``."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns = exact_patterns(np.flatnonzero(left), size)
    plan = rounded(*sparse_fit(patterns, left), left)
    plan += best_fit(left, size)
    runs: list[tuple[int, int, int, int]] = []
    ranks = np.zeros(size + 1, np.int64)
    base = 0
    for pattern, n in plan:
        offset = 0
        for v in pattern:
            runs.append((v, int(ranks[v]), base, offset))
            ranks[v] += n
            offset += v
        base += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*table.T, plan)


def _pieces(vocabulary: str, end_id: int, size: int):
    end = np.array([end_id], "<u2").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary, True).encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(found + end, "<u2").astype("<u4")
                for k, start in enumerate(range(0, len(ids), size)):
                    piece = ids[start : start + size]
                    rows.append((doc_id, k, start, len(piece), zlib.crc32(piece), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return cut


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, size: int = LENGTH) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(vocabulary, end_id, size), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, size: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = materialize(pieces(docs, vocabulary, end_id, size), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = make_plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast((plan.length * (1 << 44) + plan.first, plan.first, plan.sequence, plan.offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = shared.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            found = [pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
