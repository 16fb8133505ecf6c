"""Name to query and name to reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.plans import cells, context, governance, governed, inventory, jobs, places, planner, rules, warehouse

MODULES = (warehouse, places, governance, planner, inventory, jobs, context, rules, governed, cells)


def entries() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        for name, entry in module.ENTRIES.items():
            if name in found:
                raise ValueError(f"two queries named {name}")
            found[name] = entry
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry[0] for name, entry in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in entries().items() if entry[1]}
