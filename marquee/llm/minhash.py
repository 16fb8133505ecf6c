"""Near-duplicates by one-permutation MinHash, with links confirmed on full shingle sets.

A document's set is its distinct word shingles.  Equal sets are one node, so exact
copies are never compared.  One permutation deals a set's hashes to bins and each bin
keeps its least; empty bins take the value of a full one by optimal densification
(attempt after attempt of a 2-universal choice), so small sets behave as large ones.
Bins are joined to bands, and nodes that share a band's value share a bucket.

Two bandings follow one another.  NARROW has few values a band and misses a pair at
the threshold with a probability of 3e-9: a bucket of two nodes is a candidate pair
as it stands; nodes of larger buckets are banded again by STRICT, which misses as
little (5e-10) and parts what merely shares a passage.  Its buckets give stars: an
edge from the least node to each other.  So there are at most as many edges as places
in buckets.

A star's edges do not say that its ends are similar, only who must be compared with
whom: the stars' components are clusters, and within a cluster every two nodes that
are not linked already are compared on full sets.  A cluster is cut into blocks of
bounded size.  A block finds its own links by breadth-first search, in which a node
is compared with those not yet reached.  What lies outside a cluster's largest group
of linked nodes then visits all its blocks, a bounded number at a time, until no pair
of unlinked nodes is left uncompared.  The links found span the groups; no list of all
pairs of a group is made.

Shingles are told apart by 64-bit hashes of their words' 64-bit hashes, sets by 128
bits.  Sets of candidates alone are shuffled and stored.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; a text of
fewer words than a shingle has the whole sequence as its one shingle; null and wordless
texts have an empty set, are linked with nothing and keep their own id.  Rows with equal
ids are compared each by its text.  A null id takes no part in choosing the smallest id,
but its text links others; it is never kept, and a component without any id has a null
component_id.  Ties and repeated rows: equal sets are one node.  Texts of any length are
taken whole; columns other than ``doc_id`` and ``text`` are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm import memo
from marquee.llm.components import components
from marquee.llm.scratch import materialize

SHINGLE = 3
#: Nodes link if the intersection has at least this many per cent of the union.
PERCENT = 85
#: Bands and values a band of the two bandings.
NARROW, STRICT = (42, 6), (140, 12)
#: Shingles and nodes of a block.
BLOCK_SHINGLES, BLOCK_NODES = 500_000, 2_000
#: Nodes of a cluster that visit its blocks in one round, and their shingles together.
VISITORS, VISIT_SHINGLES = 4_000, 2_000_000
#: Words a worker remembers.
CACHE = 500_000

_known: dict[bytes, int] = memo.table()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    memo.take(_known)
    if len(_known) > CACHE:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    joined = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        joined = mixed(joined ^ h[k : len(h) - width + 1 + k], k + 1)
    return np.unique(joined)


_choices: dict[int, list[np.ndarray]] = {}


def _choice(bins: int, attempt: int) -> np.ndarray:
    """The bin that each bin looks to in an attempt."""
    tables = _choices.setdefault(bins, [])
    while len(tables) <= attempt:
        at = mixed(np.arange(bins, dtype=np.uint64) + np.uint64(len(tables) * bins), 77)
        tables.append(((at >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64))
    return tables[attempt]


def signature(found: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """The least hash of each bin under one permutation; empty bins are filled from full ones.  ``found`` is not empty."""
    h = np.sort(mixed(found, seed))
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first]], full[at[first]] = h[first], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        look = _choice(bins, attempt)[empty]
        ok = full[look]
        values[empty[ok]] = values[look[ok]]
        empty, attempt = empty[~ok], attempt + 1
    return values


def bands(found: np.ndarray, shape: tuple[int, int], seed: int) -> np.ndarray:
    """A 64-bit value for each band."""
    n, width = shape
    values = signature(found, n * width, seed).reshape(n, width)
    joined = np.arange(n, dtype=np.uint64)
    for k in range(width):
        joined = mixed(joined ^ values[:, k], k + 1)
    return joined.view(np.int64)


_SKETCH = "doc_id long, hash long, low long, high long, n long, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high, n, joined = [], [], [], []
        for text in batch.column("text").cast(pa.binary()):
            found = shingles(text.as_py())
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            low.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
            high.append((digest >> 64) - (1 << 63))
            n.append(len(found))
            joined.append(bands(found, NARROW, 11) if len(found) else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, joined)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(joined) if joined else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("hash"), *(pa.array(x, pa.int64()) for x in (low, high, n)), flat], names=["doc_id", "hash", "low", "high", "n", "bands"]
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with two plain keys that tell them apart: the id (none: 0) and a hash that also says whether there is an id."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64("text", doc_id.isNull()).alias("hash"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """A row a document: its keys, its set's 128 bits and size, and its bands."""
    return _keyed(docs).mapInArrow(_sketched, _SKETCH)


def nodes(sketched: DataFrame) -> DataFrame:
    """A row for each distinct set that is not empty, with a number, its smallest id and one document that has it."""
    some = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")
    grouped = sketched.where("n > 0").groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.min(some).alias("some"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "low", "high", "least", F.col("some.id").alias("id"), F.col("some.hash").alias("hash"), "n", "bands"), "nodes")


def shared_buckets(places: DataFrame) -> DataFrame:
    """The buckets that hold two or more of the places (bucket, node): how many, the least node and the greatest."""
    found = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    return materialize(found.where("n > 1"), "buckets")


def stars(places: DataFrame) -> DataFrame:
    """Edges (u, v) from each node of a bucket to the bucket's least."""
    found = places.join(shared_buckets(places), "bucket").where("node <> least")
    return materialize(found.select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "stars")


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x.as_py()).tobytes() for x in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("crowd"), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array(found, pa.binary())], names=["node", "crowd", "n", "found"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted nodes (node, id, hash, crowd), each from one document."""
    texts = _keyed(docs).select(F.coalesce("doc_id", F.lit(0)).alias("id"), "hash", "text")
    # Repeated rows: equal ids and texts.
    one = texts.join(wanted, ["id", "hash"]).groupBy("id", "hash").agg(F.first("node").alias("node"), F.first("crowd").alias("crowd"), F.first("text").alias("text"))
    return materialize(one.select("node", "crowd", "text").mapInArrow(_to_sets, "node long, crowd boolean, n long, found binary"), "sets")


def _strict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        for k, found in enumerate(batch.column("found")):
            values = bands(np.frombuffer(found.as_py(), np.uint64), STRICT, 13)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), node[k]))], names=["bucket", "node"])


def linked(one: int, other: int, common: int) -> bool:
    return 100 * common >= PERCENT * (one + other - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        keep = []
        for k, (a, b) in enumerate(zip(batch.column("one"), batch.column("other"))):
            a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            keep.append(linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))))
        at = np.array(keep, bool)
        yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at])], names=["u", "v"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked by their full sets; sizes that rule a link out are dropped before sets are brought together."""
    one = sets.select(F.col("node").alias("u"), F.col("n").alias("n_one"), F.col("found").alias("one"))
    other = sets.select(F.col("node").alias("v"), F.col("n").alias("n_other"), F.col("found").alias("other"))
    sizes = [x.drop(c) for x, c in ((one, "one"), (other, "other"))]
    able = 100 * F.least("n_one", "n_other") >= PERCENT * F.greatest("n_one", "n_other")
    some = materialize(pairs.join(sizes[0], "u").join(sizes[1], "v").where(able).select("u", "v"), "pairs")
    return some.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInArrow(_confirmed, "u long, v long")


class Block:
    """Sets of some nodes, brought to a form in which one set is compared with all."""

    def __init__(self, node: np.ndarray, found: list[np.ndarray]):
        self.node, self.sizes = node, np.array([len(x) for x in found], np.int64)
        self.words, self.at = np.unique(np.concatenate(found), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def links(self, found: np.ndarray) -> np.ndarray:
        """Whether each node is linked with a set."""
        place = np.searchsorted(self.words, found)
        place[place == len(self.words)] = 0
        has = np.zeros(len(self.words), np.int64)
        has[place[self.words[place] == found]] = 1
        common = np.add.reduceat(has[self.at], self.starts)
        return 100 * common >= PERCENT * (self.sizes + len(found) - common)

    def groups(self, found: list[np.ndarray]) -> np.ndarray:
        """The least node that each reaches over links within the block."""
        label = np.full(len(found), -1, np.int64)
        for start in np.argsort(self.node, kind="stable"):
            if label[start] >= 0:
                continue
            label[start], queue = start, [start]
            while queue:
                near = np.flatnonzero(self.links(found[queue.pop()]) & (label < 0))
                label[near] = start
                queue += near.tolist()
        return self.node[label]


def _read(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return table.column("node").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("found")]


_RESIDENT = "cluster long, block int, node long, found binary, local long"


def _at_home(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    node, found = _read(table)
    local = Block(node, found).groups(found)
    return table.select(["cluster", "block", "node", "found"]).append_column("local", pa.array(local, pa.int64()))


def _visited(key: tuple[pa.Scalar, ...], table: pa.Table, visitors: pa.Table) -> pa.Table:
    """An edge from each visitor to each local group of which it is linked with a member."""
    u, v = [], []
    if table.num_rows:
        block, local = Block(*_read(table)), table.column("local").to_numpy()
        for node, found in zip(*_read(visitors)):
            for other in np.unique(local[block.links(found)]).tolist():
                u.append(int(node))
                v.append(other)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def cluster_links(edges: DataFrame, sets: DataFrame, shingles_: int = BLOCK_SHINGLES, nodes_: int = BLOCK_NODES, visitors_: int = VISITORS, visit_shingles: int = VISIT_SHINGLES) -> DataFrame:
    """Links (u, v) that span the groups of linked nodes within each component of ``edges``."""
    spark = sets.sparkSession
    joined = components(edges)
    member = joined.select(F.col("u").alias("node"), F.col("v").alias("cluster")).union(joined.select("v", "v").distinct())
    member = materialize(sets.select("node", "n").join(member, "node"), "members")
    need = F.greatest(F.ceil(F.sum("n") / shingles_), F.ceil(F.count(F.lit(1)) / nodes_)).cast("int")
    clusters = materialize(member.groupBy("cluster").agg(need.alias("blocks")), "clusters")
    placed = member.join(clusters, "cluster").select("node", "cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    full = sets.select("node", "found").join(placed, "node").select("cluster", "block", "node", "found")
    home = full.groupBy("cluster", "block").applyInArrow(_at_home, _RESIDENT)
    home = materialize(home, "residents")
    links = home.where("node <> local").select(F.col("node").alias("u"), F.col("local").alias("v"))
    large = materialize(clusters.where("blocks > 1"), "large")
    if large.isEmpty():
        return links
    residents = home.join(large.select("cluster"), "cluster").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cluster", "block").persist(StorageLevel.DISK_ONLY)
    narrow = materialize(residents.join(sets.select("node", "n"), "node").select("cluster", "node", "n", F.col("local").alias("group")), "narrow")
    group, found, done = narrow, None, None
    while True:
        # All pairs are compared once every node outside some set of linked nodes has visited; the largest local group is one.
        sizes = group.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("k"))
        largest = sizes.groupBy("cluster").agg(F.max(F.struct("k", "group")).alias("top")).select("cluster", F.col("top.group").alias("group"))
        left = group.join(largest, ["cluster", "group"], "left_anti")
        left = left if done is None else left.join(done, "node", "left_anti")
        order = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
        first = left.select("cluster", "node", "n", F.row_number().over(order).alias("k")).where(F.col("k") <= visitors_ + 1)
        first = materialize(first.select("*", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto")), "visitors")
        chosen = first.where((F.col("k") <= visitors_) & ((F.col("upto") <= visit_shingles) | (F.col("k") == 1))).select("cluster", "node")
        visiting = first.agg(F.count(F.lit(1)), F.count_if((F.col("k") > visitors_) | ((F.col("upto") > visit_shingles) & (F.col("k") > 1)))).first()
        if not visiting[0]:
            break
        calls = chosen.join(large, "cluster").select("node", F.col("cluster").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
        calls = calls.join(sets.select("node", "found"), "node")
        met = residents.groupBy("cluster", "block").cogroup(calls.groupBy("to", "at")).applyInArrow(_visited, "u long, v long").where("u <> v")
        found = materialize(met if found is None else found.union(met), "links")
        if not visiting[1]:
            break
        done = materialize(chosen.select("node") if done is None else done.union(chosen.select("node")), "done")
        root = components(found.union(narrow.where("node <> group").select(F.col("node").alias("u"), F.col("group").alias("v"))))
        group = narrow.join(root, narrow["node"] == root["u"], "left").select("cluster", "node", "n", F.coalesce("v", "node").alias("group"))
    residents.unpersist()
    return links if found is None else links.union(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    sketched = materialize(sketches(docs), "sketches")
    node = nodes(sketched)
    places = node.select("node", F.explode("bands").alias("bucket"))
    shared = shared_buckets(places)
    pairs = shared.where("n = 2").select(F.col("least").alias("u"), F.col("most").alias("v")).distinct()
    crowded = places.join(shared.where("n > 2").select("bucket"), "bucket", "left_semi").select("node").distinct()
    named = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.lit(False).alias("crowd")).union(crowded.select("node", F.lit(True)))
    named = named.groupBy("node").agg(F.max("crowd").alias("crowd"))
    sets = sets_of(docs, node.select("node", "id", "hash").join(named, "node"))
    links = cluster_links(stars(sets.where("crowd").select("node", "found").mapInArrow(_strict, "bucket long, node long")), sets)
    every = materialize(confirmed(pairs, sets).union(links), "links")
    root = components(every)
    rooted = node.join(root, node["node"] == root["u"], "left").select("low", "high", "least", F.coalesce("v", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select("low", "high", "component_id", F.lit(True).alias("found"))
    joined = sketched.select("doc_id", "low", "high", F.col("n").alias("n_shingles")).join(labels, ["low", "high"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return joined.select("doc_id", "n_shingles", component).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= {PERCENT} * (a.n + b.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u),
g AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""
