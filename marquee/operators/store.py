"""Write-once snapshots, appends, upserts and the checks before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks."""
    return new.join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """``first`` columns keep the old value, ``last`` columns take the new one."""
    a = old.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in (*first, *last)])
    b = new.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in (*first, *last)])
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in first], *[F.coalesce(f"__b_{c}", f"__a_{c}").alias(c) for c in last])


def drift(old: DataFrame, new: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Keys that both have with different contents; nulls equal nulls."""
    columns = [c for c in old.columns if c not in keys and c not in ignore]
    a = old.select(*keys, F.struct(*columns).alias("__a"))
    b = new.select(*keys, F.struct(*columns).alias("__b"))
    return a.join(b, keys).where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the codes of all rules they break; a null verdict counts as broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()]))
    return df.select(*keys, codes.alias("violations")).where(F.size("violations") > 0)


def ensure_empty(df: DataFrame, code: str) -> None:
    """Raise if there is a row; looks at one at most."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{code}: {found[0].asDict()}")


def write_snapshot(df: DataFrame, folder: str, snapshot_id: str) -> bool:
    """Write one snapshot's partition once.  False if it is there already with equal contents; other contents are an error."""
    spark = df.sparkSession
    path = f"{folder}/snapshot_id={snapshot_id}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.schema(df.schema).parquet(path)
        ensure_empty(old.exceptAll(df).union(df.exceptAll(old)), "SNAPSHOT_IMMUTABLE")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True
