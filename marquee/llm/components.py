"""Connected components of an undirected graph held as a frame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.scratch import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """For a frame of edges (u, v): each node but the smallest of its component as ``u``, that smallest as ``v``.

    Alternates large-star and small-star steps until nothing changes; the rows
    never outnumber the edges, and no node's neighbours are gathered: a step is
    an aggregate by node and a join on it, which adaptive execution may split.
    """
    pair = F.struct("u", "v")
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    held = materialize(ordered.distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(pair) % 1_000_003), F.sum(F.xxhash64(pair) % 998_244_353)).first())

    now = state(held)
    while now[0]:
        moved = materialize(_small_star(_large_star(held).distinct()).distinct(), "edges")
        drop(held)
        held, before, now = moved, now, state(moved)
        if now == before:
            break
    return held
