"""FTRL-proximal logistic regression over hashed word features, fitted to a bounded sample of labelled texts.

The sample is bounded in documents and in features.  Texts are turned into their
distinct feature numbers where they are read; only these travel, at most 2**BITS a
text however long it is, and the sample ends before the sum of their counts passes
FEATURES.  One task fits one model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.features import grams, word_hashes

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 3
#: Feature numbers of 4 bytes that a sample holds at most, unless its first text alone has more.
FEATURES = 30_000_000


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; coordinate ``2**BITS`` is the intercept, which is not regularised."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.bias = 2**bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, label: float) -> None:
        """One example, whose features ``at`` end with the intercept."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(found: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and the weights; the intercept's bucket is ``2**bits``."""
    model = Ftrl(bits)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(found)):
            model.update(np.append(found[i], model.bias), labels[i])
    at = np.arange(2**bits + 1)
    w = model.weights(at)
    return at[w != 0], w[w != 0]


def sampled(docs: DataFrame, marks: DataFrame, sample: int, order: int, skips: int) -> DataFrame:
    """Rows (h, mark, features, n) of at most ``sample`` rows of ``docs`` whose doc_id ``marks`` (id, mark) has once.

    Ids are taken in order of their hash, and of one id's rows those of smaller text hash first.
    """
    key = F.xxhash64(F.col("id").cast("string"))
    chosen = marks.orderBy(key, "id").limit(sample)
    # At most ``sample`` short rows, so this side may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = rows.select(key.alias("h"), F.xxhash64("text").alias("t"), "mark", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(word_hashes(x.as_py()), BITS, order, skips).astype("<u4") for x in batch.column("text")]
            columns = [*(batch.column(c) for c in ("h", "t", "mark")), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "t", "mark", "features", "n"])

    kind = dict(marks.dtypes)["mark"]
    features = rows.mapInArrow(featurise, f"h long, t long, mark {kind}, features binary, n long").orderBy("h", "t", "mark").limit(sample)
    upto = F.sum("n").over(Window.orderBy("h", "t", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return features.withColumn("upto", upto).where((F.col("upto") <= FEATURES) | (F.col("upto") == F.col("n"))).drop("upto")


def unpacked(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("features")]


def dense(at: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """All weights by bucket, the intercept last."""
    w = np.zeros(2**bits + 1)
    w[at] = weights
    return w


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
