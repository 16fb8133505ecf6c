"""Small tables from Python values, with a size that the optimiser knows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A local relation: joins with it can be planned as broadcasts because Spark sees how small it is."""
    return spark.createDataFrame(pa.table({c: pa.array(v, types[c]) for c, v in columns.items()}))
