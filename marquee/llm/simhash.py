"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits have a bit string between
them that differs from either in at most half of RADIUS.  So each distinct
fingerprint emits all variants within half the radius, and fingerprints that
share a variant are neighbours.

The 2,081 variants of a fingerprint are not shuffled one by one.  They are
shuffled in bundles: all its variants that agree in their leading block bits
travel as one row (block value, fingerprint), 37 rows for 8 block bits, and the
task that gets a block value spells the variants out, finds equal ones, verifies
the pairs and returns a spanning forest of them.  The number of block bits
follows the number of fingerprints, so bundles keep their size; a block value
that still gathers too many fingerprints is cut by further bits, again and again.
What is crowded down to single variants is linked by an aggregate, without a
group in memory: all fingerprints of a variant are neighbours.

Exact copies share a fingerprint, so only distinct fingerprints are compared, and
they are the graph's nodes; ids come in when the components stand.  The rows
shuffled per fingerprint grow with the block bits: 37 at 8, 137 at 16, 301 at 24.

Defined cases: null and wordless texts have fingerprint zero and are linked as
any other.  Rows with equal ids are fingerprinted each and belong to the component
of their fingerprint, whatever other texts the id has.  A null id takes no part in
choosing the smallest id, but its text links others; a component without any id has
a null component_id.  Texts of any length are taken whole.  ``keep_documents`` keeps
one row of each component, that of the smallest id (of equal ids, that of the
smallest text hash; without any id, likewise), with all its columns, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.scratch import materialize

SHINGLE = 4
RADIUS = 4
HALF = RADIUS // 2
#: Variants that one bundle should hold, which sets the number of block bits.
BUNDLE = 2_000_000
BLOCK_BITS = (8, 24)
#: Variants of one block value beyond which it is cut by CUT_BITS more bits.
CROWDED = 4 * BUNDLE
CUT_BITS = 8


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: bytes | None) -> int:
    """64 bits as a signed integer: a bit is set if over half of the shingles' hashes have it."""
    h = shingle_hashes(text or b"")
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = pa.array((fingerprint(x.as_py()) for x in texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fp"])


def _hashed_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array((fingerprint(x.as_py()) for x in batch.column("text").cast(pa.binary())), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "hash", "nameless")), prints], names=["id", "hash", "nameless", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks within ``bits`` bits by their number of ones, 0 to ``most``."""
    return [np.array([sum(1 << k for k in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def block_bits(prints: int) -> int:
    variants = sum(len(x) for x in flips(64, HALF))
    need = int(np.ceil(np.log2(max(1, prints * variants / BUNDLE))))
    return min(max(need, BLOCK_BITS[0]), BLOCK_BITS[1])


def _bundles(width: int):
    """Rows (block, used, fp) of the block values that a fingerprint's variants have; ``used`` counts flips in the block."""
    masks = flips(width, HALF)
    flat = np.concatenate(masks)
    used = np.repeat(np.arange(HALF + 1, dtype=np.int8), [len(m) for m in masks])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for k in range(0, len(fp), 8192):
                part = fp[k : k + 8192]
                block = ((part >> np.uint64(64 - width))[:, None] ^ flat).ravel().astype(np.int64)
                n = len(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(np.tile(used, len(part))), pa.array(np.repeat(part.view(np.int64), n))], names=["block", "used", "fp"]
                )

    return emit


def _cut(width: int, bits: int):
    """Bundles of crowded blocks are cut by the next ``bits`` bits; ``used`` goes on counting."""
    masks = flips(bits, HALF)
    shift, low = np.uint64(64 - width - bits), np.uint64((1 << bits) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, used, fp = (np.asarray(batch.column(c)) for c in ("block", "used", "fp"))
            own = (fp.view(np.uint64) >> shift) & low
            for n in range(HALF + 1):
                at = np.flatnonzero(used + n <= HALF)
                m = masks[n]
                if not len(at):
                    continue
                sub = (own[at][:, None] ^ m).ravel().astype(np.int64)
                rep = np.repeat(at, len(m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block[rep] << bits) | sub), pa.array((used[rep] + n).astype(np.int8)), pa.array(fp[rep])], names=["block", "used", "fp"]
                )

    return emit


def forest(fp: np.ndarray, used: np.ndarray, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that share a variant with leading bits ``block``, and the smallest one each is linked to."""
    outer = 64 - width
    base = (fp.view(np.uint64) & np.uint64((1 << outer) - 1)) | np.uint64(block << outer)
    masks = flips(outer, HALF)
    variants, owners = [], []
    for n in range(HALF + 1):
        at = np.flatnonzero(used == n)
        if len(at):
            m = np.concatenate(masks[: HALF + 1 - n])
            variants.append((base[at][:, None] ^ m).ravel())
            owners.append(np.repeat(at.astype(np.int32), len(m)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    pairs = np.unique(np.stack([owner[:-1][same], owner[1:][same]], axis=1), axis=0) if same.any() else np.empty((0, 2), np.int32)
    a, b = pairs[:, 0], pairs[:, 1]
    near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= RADIUS
    a, b = a[near & (a != b)], b[near & (a != b)]
    root = fp.copy()
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if np.array_equal(root, before):
            break
    linked = root != fp
    return fp[linked], root[linked]


def _links(width: int):
    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fp, used = (table.column(c).to_numpy() for c in ("fp", "used"))
        u, v = forest(fp, used, key[0].as_py(), width)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return find


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all near fingerprints; ``prints`` has distinct ones as ``fp``."""
    schema = "block long, used byte, fp long"
    width = block_bits(prints.count())
    bundles = prints.select("fp").mapInArrow(_bundles(width), schema)
    found = None
    while width < 64:
        sizes = [len(m) for m in flips(64 - width, HALF)]
        variants = F.element_at(F.array(*[F.lit(sum(sizes[: HALF + 1 - n])) for n in range(HALF + 1)]), F.col("used").cast("int") + 1)
        crowded = materialize(bundles.groupBy("block").agg(F.sum(variants).alias("n")).where(F.col("n") > CROWDED).select("block"), "crowded")
        some = not crowded.isEmpty()
        apart = bundles.join(crowded, "block", "left_anti") if some else bundles
        edges = apart.groupBy("block").applyInArrow(_links(width), "u long, v long")
        found = edges if found is None else found.union(edges)
        if not some:
            return found
        bits = min(CUT_BITS, 64 - width)
        bundles = bundles.join(crowded, "block", "left_semi").select("block", "used", "fp").mapInArrow(_cut(width, bits), schema)
        width += bits
    # A block is one variant now.
    least = bundles.groupBy("block").agg(F.min("fp").alias("v"))
    return found.union(bundles.join(least, "block").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v"))


def grouped(prints: DataFrame, least: Column) -> DataFrame:
    """fp and, over its component, the least of ``least``; ``prints`` has distinct fp."""
    joined = components(links(prints))
    rooted = prints.join(joined, prints["fp"] == joined["u"], "left").withColumn("root", F.coalesce("v", "fp")).drop("u", "v")
    roots = rooted.groupBy(F.col("root").alias("__root")).agg(least.alias("least"))
    return rooted.join(roots, F.col("root") == F.col("__root")).select("fp", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id per row of ``docs``: the smallest doc_id reachable over near fingerprints."""
    each = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("id")), "prints")
    labels = grouped(prints, F.min("id")).select(F.col("fp").alias("__fp"), F.col("least").alias("component_id"))
    return each.join(labels, each["fp"] == labels["__fp"], "left").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    # Null ids are told apart in the hash, so that join and aggregate share one dealing by two plain keys.
    nameless = F.col("doc_id").isNull()
    rows = docs.select(held, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text", nameless).alias("hash"), nameless.alias("nameless"))
    each = rows.select("id", "hash", "nameless", F.col("doc.text").alias("text")).mapInArrow(_hashed_prints, "id long, hash long, nameless boolean, fp long")
    prints = materialize(each.groupBy("fp").agg(F.min(F.struct("nameless", "id", "hash")).alias("first")), "prints")
    kept = grouped(prints, F.min("first")).select("least.id", "least.hash").distinct()
    chosen = rows.select("doc", "id", "hash").join(kept, ["id", "hash"], "left_semi")
    # Repeated rows: equal ids and texts.
    return chosen.groupBy("id", "hash").agg(F.first("doc").alias("doc")).select("doc.*")
