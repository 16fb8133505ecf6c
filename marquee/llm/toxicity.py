"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word n-grams and skip-grams, each either present or absent.
The learner keeps a learning rate per coordinate and an L1 term that leaves most
weights at exactly zero, so the model is a short list of (bucket, weight) that is
broadcast; its size is bounded by the number of buckets.

It is fitted to a bounded sample of the labelled rows (SAMPLE rows, those of the
smallest hashed ids, with at most ``ftrl.FEATURES`` features) in one task; all texts are scored.

Defined cases: a null or empty text has no features and gets the score of the
intercept alone; several labels of one document count as toxic if any is; labels
without a document and documents without an id teach nothing; with no labelled
row every score is a little less than 0.5, so nothing is flagged.  Repeated rows are
scored each; very long texts whole; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.features import grams, word_hashes
from marquee.llm.ftrl import BITS, dense, logistic, sampled, train, unpacked

ORDER = 2
SKIPS = 2
#: Labelled rows that are learned from, at most.
SAMPLE = 12_000
#: Intercept when nothing could be learned.
UNKNOWN = -1e-6


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("h", "ascending"), ("t", "ascending"), ("mark", "ascending")])
    at, w = train(unpacked(table), table.column("mark").to_pylist())
    return pa.table({"bucket": pa.array(at, pa.int64()), "weight": pa.array(w, pa.float64())})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights from at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = known.groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("mark"))
    rows = sampled(docs, marks, sample, ORDER, SKIPS)
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_fit, "bucket long, weight double").collect()
    if not fitted:
        return np.array([2**BITS]), np.array([UNKNOWN])
    return np.array([r[0] for r in fitted], np.int64), np.array([r[1] for r in fitted], np.float64)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dense(*shared.value)
        for batch in batches:
            sums = [w[grams(word_hashes(text), BITS, ORDER, SKIPS)].sum() + w[-1] for text in batch.column("text").to_pylist()]
            scores = logistic(np.array(sums, float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
