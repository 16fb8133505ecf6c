"""Approximate nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors of length one are projected with Gaussian (2-stable) weights to a few
dimensions, where the squared distance of two vectors divided by their true one
follows a chi-square law.  A kd-tree over the projections returns points in order
of projected distance; each is verified with the true distance, and the search
stops when the law says that a nearer vector would by now have turned up with
probability CERTAINTY (Sun et al., 2014).

The top of the tree is cut on a bounded sample of projections and gives the
shards; every vector is indexed in the shard of its leaf, and large leaves are
split further by id, whatever vectors they hold.  A query is searched in its own
leaf first.  The distance to its K-th find then tells which other leaves the stop
rule leaves open, and it is sent to those only.  Inside a task the tree goes on
down to buckets; a block of queries is taken through the buckets together, each
query through those that its stop rule leaves open, and in a bucket only vectors
whose projections are near enough are verified.  Vectors are sent once to their
shard; only when more than BLOCK_BYTES of queries ask for one is the shard copied,
once for each further block, so copies never outweigh the queries they serve.

How many leaves stay open depends on the vectors.  Neighbours much nearer than the
rest leave few; where all distances are alike, as for independent directions in 64
dimensions, the rule leaves nearly all leaves open at any size, and only the part
of vectors verified falls.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers take
no part, neither do rows without an id.  Vectors of different lengths are no
neighbours; each length is searched by itself.  Equal vectors are kept together in
a bucket and give way to smaller ids.  A repeated query id is searched once, by the
least of its vectors (by their bytes); only that row is no candidate of its own, the
id's other rows and repeated candidates count each.  Other columns, whatever their
names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.scratch import materialize

K = 5
DIMENSIONS = 16
CERTAINTY = 0.95
SEED = 20260101
#: Rows of a shard, at most about twice as many.
SHARD = 16_384
#: Rows whose projections the top of the tree is cut on, and leaves it may have.
SAMPLE = 20_000
LEAVES = 1024
#: Bytes of queries that ask for one copy of a shard, and queries searched together.
BLOCK_BYTES = 64 * 2**20
TOGETHER = 512
BUCKET = 256
#: Finds that a query carries along: K, its own row, and near ties.
CARRIED = K + 5
#: Slack for comparing cosines that were summed in different order.
SLACK = 1e-9


def chi_square_bound(certainty: float, dimensions: int = DIMENSIONS) -> float:
    """The value that a chi-square variable of an even number of dimensions stays below with this probability."""

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dimensions // 2):
            term *= x / 2 / j
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < certainty else (low, mid)
    return high


def weights(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMENSIONS))


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    """A matrix of the binary column's 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest number first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(size: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if v is None or len(v) != size or None in v:
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    found.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["vec_id", "v"])

    return clean


class Top:
    """The top of the tree: splits, and the box of each leaf."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._cut(points, leaves, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf))
        self.boxes = np.array(self.low), np.array(self.high)

    def _cut(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        """Number of an inner node, or -1 less the number of a leaf."""
        if leaves > 1 and len(points):
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            at = float(np.median(points[:, axis]))
            left = points[:, axis] < at
            if left.any():
                me = len(self.splits)
                self.splits.append((axis, at, 0, 0))
                upper, lower = high.copy(), low.copy()
                upper[axis] = lower[axis] = at
                a = self._cut(points[left], leaves // 2, low, upper)
                b = self._cut(points[~left], leaves - leaves // 2, lower, high)
                self.splits[me] = (axis, at, a, b)
                return me
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        while (inner := node >= 0).any():
            for k in np.unique(node[inner]):
                axis, at, a, b = self.splits[k]
                here = np.flatnonzero(node == k)
                node[here] = np.where(points[here, axis] < at, a, b)
        return -node - 1

    def open(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of points and of leaves whose boxes are within the points' squared distances ``reach``."""
        return np.nonzero(gaps(points, *self.boxes) <= reach[:, None])


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    found = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        found += np.maximum(0, np.maximum(low[:, axis] - p, p - high[:, axis])) ** 2
    return found


class Tree:
    """A kd-tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        _, first, group = np.unique(np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.original = vectors[order][first]
        by_group = np.argsort(group.ravel(), kind="stable")
        starts = np.searchsorted(group.ravel()[by_group], np.arange(len(first) + 1))
        # K + 1 smallest ids of equal vectors: one may be the query's own.
        self.ids = [ids[order][by_group[a : min(b, a + K + 1)]] for a, b in zip(starts, starts[1:])]
        self.x = unit(self.original)
        self.p = self.x @ weights(vectors.shape[1])
        self.buckets: list[np.ndarray] = []
        self._build(np.arange(len(self.x)))
        self.low, self.high = (np.array([f(self.p[b], axis=0) for b in self.buckets]) for f in (np.min, np.max))

    def _build(self, at: np.ndarray) -> None:
        if len(at) <= BUCKET:
            self.buckets.append(at)
            return
        p, half = self.p[at], len(at) // 2
        order = np.argpartition(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], half)
        self._build(at[order[:half]])
        self._build(at[order[half:]])

    def search(self, q: np.ndarray, within: np.ndarray, bound: float) -> np.ndarray:
        """For each query the CARRIED nearest vectors found, -1 for none; ``within`` are squared distances known to hold K vectors."""
        p = q @ weights(q.shape[1])
        gap = gaps(p, self.low, self.high)
        near = np.full((len(q), CARRIED), -1, np.int64)
        cosine = np.full((len(q), CARRIED), -np.inf)
        within = within.copy()
        left = np.ones(gap.shape, bool)

        def visit(bucket: int, who: np.ndarray) -> None:
            left[who, bucket] = False
            rows = self.buckets[bucket]
            projected = (p[who] ** 2).sum(axis=1)[:, None] + (self.p[rows] ** 2).sum(axis=1) - 2 * p[who] @ self.p[rows].T
            open_ = projected <= within[who, None] * bound + SLACK
            some, any_row = open_.any(axis=1), open_.any(axis=0)
            if not some.any():
                return
            who, open_, rows = who[some], open_[np.ix_(some, any_row)], rows[any_row]
            found = np.where(open_, q[who] @ self.x[rows].T, -np.inf)
            both = np.concatenate([cosine[who], found], axis=1)
            at = np.argpartition(-both, CARRIED - 1, axis=1)[:, :CARRIED]
            near[who] = np.take_along_axis(np.concatenate([near[who], np.broadcast_to(rows, found.shape)], axis=1), at, axis=1)
            cosine[who] = np.take_along_axis(both, at, axis=1)
            # One row may be the query's own, so K + 1 rows hold K others.
            kth = -np.partition(-cosine[who], K, axis=1)[:, K]
            within[who] = np.minimum(within[who], np.where(np.isfinite(kth), np.maximum(0, 2 - 2 * np.maximum(kth, -1)) + SLACK, np.inf))

        first = gap.argmin(axis=1)
        for bucket in np.unique(first):
            visit(int(bucket), np.flatnonzero(first == bucket))
        for bucket in np.argsort(gap.mean(axis=0)):
            who = np.flatnonzero(left[:, bucket] & (gap[:, bucket] <= within * bound))
            if len(who):
                visit(int(bucket), who)
        return np.where(np.isfinite(cosine), near, -1)

    def best(self, own: int, original: np.ndarray, near: np.ndarray) -> list[tuple[float, int]]:
        """The K best (score, id) of the vectors ``near`` but the query's own row, by the original numbers."""
        found = []
        size = float(np.sqrt(original @ original))
        for k in near[near >= 0]:
            v = self.original[k]
            score = float(original @ v) / (size * float(np.sqrt(v @ v)))
            ids = self.ids[k].tolist()
            if own in ids and np.array_equal(v, original):
                ids.remove(own)
            found += [(-score, i) for i in ids]
        return [(-s, i) for s, i in sorted(found)[:K]]


_FOUND = "query_id long, vec_id long, score double"


def _search(size: int, bound: float):
    def search(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(rows):
            tree = Tree(rows.column("vec_id").to_numpy(), rows_of(rows.column("v"), size))
            originals = rows_of(queries.column("v"), size)
            names, within = queries.column("vec_id").to_pylist(), queries.column("within").to_numpy()
            for a in range(0, len(names), TOGETHER):
                part = slice(a, a + TOGETHER)
                for own, original, near in zip(names[part], originals[part], tree.search(unit(originals[part]), within[part], bound)):
                    out += [(own, i, s) for s, i in tree.best(own, original, near)]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return search


def neighbours(vectors: DataFrame, is_query: Column, certainty: float = CERTAINTY) -> DataFrame:
    """query_id, rank, vec_id and score of the K nearest by cosine; ``vectors`` has vec_id and embedding."""
    raw = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = raw.where(F.size("v") > 0).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    found = [_of_size(raw, size, total, is_query, certainty) for size, total in sizes]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _of_size(raw: DataFrame, size: int, total: int, is_query: Column, certainty: float) -> DataFrame:
    """``neighbours`` of vectors of one length."""
    spark = raw.sparkSession
    bound = chi_square_bound(certainty)
    clean = raw.mapInArrow(_clean(size), "vec_id long, v binary")

    leaves = min(LEAVES, max(1, -(-total // SHARD)))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    top = spark.sparkContext.broadcast(Top(unit(rows_of(sample.column("v"), size)) @ weights(size), leaves))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = top.value.leaf(unit(rows_of(batch.column("v"), size)) @ weights(size))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    placed = materialize(clean.mapInArrow(place, "vec_id long, v binary, leaf int"), "vectors")
    queries = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "leaf")).alias("q")).select("vec_id", "q.v", "q.leaf")
    # At most LEAVES rows.
    shards = {r[0]: -(-r[1] // SHARD) for r in placed.groupBy("leaf").count().collect()}
    split = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]) if shards else F.lit(None).cast("map<int,int>")

    def searched(asked: DataFrame) -> DataFrame:
        """``asked`` has vec_id, v, leaf and within; each goes to all shards of its leaf."""
        blocks = {r[0]: -(-r[1] * 8 * size // BLOCK_BYTES) for r in asked.groupBy("leaf").count().collect()}
        if not blocks:
            return spark.createDataFrame([], _FOUND)
        many = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
        sent = asked.select("vec_id", "v", "within", "leaf", F.explode(F.sequence(F.lit(0), split[F.col("leaf")] - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id"), many[F.col("leaf")]).cast("int").alias("block"))
        rows = placed.where(F.col("leaf").isin(list(blocks))).select(
            "vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id", F.lit(1)), split[F.col("leaf")]).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), many[F.col("leaf")] - 1)).alias("block")
        )
        keys = ("leaf", "shard", "block")
        return sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_search(size, bound), _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialize(searched(queries.withColumn("within", F.lit(4.0))), "near")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)
    reach = near.groupBy(F.col("query_id").alias("__q")).agg(F.when(F.count(F.lit(1)) == K, F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + SLACK).otherwise(4.0).alias("within"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = unit(rows_of(batch.column("v"), size)) @ weights(size)
            within = batch.column("within").to_numpy()
            for a in range(0, len(p), TOGETHER):
                who, leaf = top.value.open(p[a : a + TOGETHER], within[a : a + TOGETHER] * bound)
                who += a
                away = leaf != batch.column("leaf").to_numpy()[who]
                at = pa.array(who[away])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(leaf[away], pa.int32()), batch.column("within").take(at)], names=["vec_id", "v", "leaf", "within"])

    asked = queries.join(reach, F.col("vec_id") == F.col("__q"), "left").select("vec_id", "v", "leaf", F.coalesce("within", F.lit(4.0)).alias("within"))
    asked = materialize(asked.mapInArrow(spread, "vec_id long, v binary, leaf int, within double"), "asked")
    found = near.select("query_id", "vec_id", "score").union(searched(asked))
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= K)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
