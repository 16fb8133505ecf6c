"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote.  The first three drop documents, the
fourth repeats or drops them by fitted rates, the fifth returns their places in
sequences.  SQL cannot state several of the stages, so ``ORACLE_SQL`` is
None and the tests compare with a brute-force version.
"""

from __future__ import annotations

import weakref
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import language_id, mixing, packing, quality_rules, simhash
from marquee.llm.scratch import materialize

ORACLE_SQL = None

#: Rows of an Arrow batch.  Whole documents travel in them, and a batch is held several times over in an executor.
BATCH_ROWS = 1_000
_OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"


class SmallBatches:
    """Arrow batches of BATCH_ROWS rows in a session while any frame that a stage returned is alive; then the session's own value again."""

    held = 0
    own: str | None = None

    @classmethod
    def hold(cls, df: DataFrame) -> DataFrame:
        weakref.finalize(df, cls.release, df.sparkSession)
        return df

    @classmethod
    def begin(cls, spark: SparkSession) -> None:
        if not cls.held:
            cls.own = spark.conf.get(_OPTION)
            spark.conf.set(_OPTION, BATCH_ROWS)
        cls.held += 1

    @classmethod
    def release(cls, spark: SparkSession) -> None:
        cls.held -= 1
        if not cls.held and spark.sparkContext._jsc is not None:
            spark.conf.set(_OPTION, cls.own)


def in_small_batches(stage):
    """The stage with small batches until its frame is dropped."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        SmallBatches.begin(spark)
        try:
            found = stage(spark, docs, sf_dir)
        except BaseException:
            SmallBatches.release(spark)
            raise
        return SmallBatches.hold(found)

    return run_stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by profiles learned from the documents themselves."""
    return language_id.keep_documents(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the labelled domains ask for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix_documents(docs, mixing.label_domains(labels), mixing.TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [(name, in_small_batches(stage)) for name, stage in (("languages", languages), ("rules", rules), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
