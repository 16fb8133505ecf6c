"""Late re-issues and replays, as a batch and as a stream with state.

A source publishes a year's rows in issues with growing revisions; a later issue of a year takes the place of earlier
ones, whenever it arrives.  A delivery may come twice, and issues may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of any form needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ("source", "year", "revision", "n_rows", "total")
CHANGE = "source string, year long, revision long, n_rows long, total double, status string, sequence long"


def current_issues(issues: DataFrame) -> DataFrame:
    """Per source and year the issue with the largest revision; repeated deliveries count once."""
    return issues.groupBy("source", "year").agg(F.max_by(F.struct("revision", "n_rows", "total"), "revision").alias("i")).select("source", "year", "i.*")


class Issues(StatefulProcessor):
    """Keeps the largest revision of a source and year, and tells of every change of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "revision long, n_rows long, total double, sequence long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            top = batch.loc[batch["revision"].idxmax()]
            if best is None or top["revision"] > best[0]:
                best = (int(top["revision"]), int(top["n_rows"]), float(top["total"]))
        before = self.held.get() if self.held.exists() else None
        if best is None or (before is not None and best[0] <= before[0]):
            return
        sequence = 0 if before is None else int(before[3]) + 1
        self.held.update((*best, sequence))
        changes = [] if before is None else [(*key, *before[:3], "superseded", sequence)]
        changes.append((*key, *best, "current", sequence))
        yield pd.DataFrame(changes, columns=[*COLUMNS, "status", "sequence"])

    def close(self) -> None:
        pass


def issue_changes(issues: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of changes: an issue that becomes current, and the one it supersedes.

    ``issues``: delivery_id, at (time), source, year, revision, n_rows, total.  A delivery that comes again within ``late``
    is dropped before it reaches the state; one that comes later has a revision that is held already and changes nothing.
    """
    once = issues.withWatermark("at", late).dropDuplicatesWithinWatermark(["delivery_id"])
    return once.select(*COLUMNS).groupBy("source", "year").transformWithStateInPandas(Issues(), CHANGE, "Update", "None")


def folded(changes: DataFrame) -> DataFrame:
    """The issues that are current after all changes, whatever order the changes are read in."""
    last = changes.where("status = 'current'").groupBy("source", "year").agg(F.max_by(F.struct("revision", "n_rows", "total"), "sequence").alias("i"))
    return last.select("source", "year", "i.*")
