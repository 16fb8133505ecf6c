"""Rebuilding only what a change reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import assertions, parse


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ between two tables: added, removed, or with other values; a key may have several rows."""
    columns = [F.col(c) for c in sorted(old.columns)]
    tally = lambda df, sign: df.select(*keys, F.xxhash64(*columns).alias("__h"), F.lit(sign).alias("__n"))
    both = tally(old, -1).union(tally(new, 1)).groupBy(*keys, "__h").agg(F.sum("__n").alias("__n"))
    return both.where("__n <> 0").select(*keys).distinct()


def rebuilt(previous: DataFrame, affected: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``previous`` with the rows of affected keys computed anew; ``compute`` is given the affected keys."""
    return previous.join(affected, keys, "left_anti").unionByName(compute(affected))


def import_airport_aliases(links: DataFrame, names: DataFrame, aliases: DataFrame, manual: DataFrame, anchors: DataFrame, old_anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import manual airport aliases (alias_id, literal, airport): the new aliases, the links after it, and the labels that were linked anew.

    ``links`` are ``parse.airport_links`` of ``names`` (label, state) before the import.  A manual alias stands before every
    other of its key (rank 0, the lowest alias id of several).  Only labels whose key's aliases changed are linked anew, and
    those without an alias whose state's anchor changed.
    """
    keyed = manual.select("alias_id", "airport", text.entity_literal(F.col("literal")).alias("key")).where(F.col("key").isNotNull())
    chosen = keyed.groupBy("key").agg(F.min_by("airport", "alias_id").alias("airport"))
    kept = aliases.join(chosen.select("key"), "key", "left_anti").select("key", "airport", "rank")
    merged = kept.unionByName(chosen.select("key", "airport", F.lit(0).alias("rank")))
    changed = changed_rows(aliases.select("key", "airport", "rank"), merged, ["key"])
    labelled = names.select("label", "state", text.entity_literal(F.col("label")).alias("key"))
    affected = labelled.join(changed, "key", "left_semi").select("label", "state")
    if old_anchors is not None:
        states = changed_rows(old_anchors.select("state", "airport"), anchors.select("state", "airport"), ["state"])
        loose = links.where(F.col("method").isin("state_anchor", "review")).select("label", "state")
        affected = affected.union(loose.join(states, "state", "left_semi").select("label", "state"))
    affected = affected.distinct()
    after = rebuilt(links, affected, ["label", "state"], lambda some: parse.airport_links(some, merged, anchors))
    return merged, after, affected


def import_manual_overrides(held: DataFrame, manual: DataFrame, old_manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions (record_id, literal, airport_id, method, automatic) after a change of the manual aliases, and the records made anew.

    ``automatic`` is the airport found without review; a literal that loses its manual alias goes back to it.
    """
    columns = ["literal", "alias_id", "airport_id"]
    trimmed = lambda df: df.select(F.trim("literal").alias("literal"), "alias_id", "airport_id").select(*columns)
    changed = changed_rows(trimmed(old_manual), trimmed(manual), ["literal"])
    reached = held.join(changed, F.trim(held["literal"]) == changed["literal"], "left_semi")
    plain = reached.select("record_id", "literal", F.col("automatic").alias("airport_id"), F.lit("automatic").alias("method"))
    again = assertions.manual_first(plain, manual).join(reached.select("record_id", "automatic"), "record_id")
    return held.join(reached.select("record_id"), "record_id", "left_anti").unionByName(again.select(*held.columns)), reached.select("record_id")
