"""Runs of several steps over a folder: each step's tables are written once, a run is committed as a whole, and readers see committed runs only.

    runs/<run>/<step>/<table>/    Parquet; the step counts as done when its _DONE file is there
    commits/<number>              one file a committed run, made by a create that fails if the name is taken
    lock                          the run that writes; made the same way

A run's id is the hash of what goes into it, so the same run started again finds its finished steps and goes on with
the first unfinished one; what a lost job left of a step without a _DONE file is removed first.  The file system must
create files without overwriting as one act (HDFS and local files do).
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


class RunError(RuntimeError):
    """A run that may not go on; the message begins with a code."""


def scratch_root(spark: SparkSession, name: str) -> str:
    """A folder that all executors share; only a local session without a checkpoint folder gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="marquee-runs-"))
    return f"{base.rstrip('/')}/marquee-runs-{spark.sparkContext.applicationId}/{name}"


def run_id(**inputs: object) -> str:
    """The id of a run with these inputs and parameters."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:32]


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _create(self, name: str, text: str) -> bool:
        """Write a small file that must not be there yet; False if it is."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                return False
            raise RunError(f"RUN_STORE_WRITE_FAILED: {name}") from e
        out.write(text.encode())
        out.close()
        return True

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def acquire(self, run: str) -> None:
        """Take the store for a run, which may hold it already from a start that was lost; another run's is an error."""
        if not self._create("lock", run) and self._text("lock") != run:
            raise RunError(f"RUN_STORE_LOCKED: {self._text('lock')}")

    def release(self, run: str) -> None:
        if self._fs.exists(self._path("lock")) and self._text("lock") == run:
            self._fs.delete(self._path("lock"), False)

    def step(self, run: str, name: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a step: read if an earlier start finished it, else built and written."""
        folder = f"runs/{run}/{name}"
        if not self._fs.exists(self._path(f"{folder}/_DONE")):
            self._fs.delete(self._path(folder), True)
            tables = build()
            for table, df in tables.items():
                df.write.parquet(f"{self.root}/{folder}/{table}")
            schemas = {table: df.schema.jsonValue() for table, df in tables.items()}
            self._create(f"{folder}/_DONE", json.dumps(schemas, sort_keys=True))
        return {table: self._table(folder, table) for table in json.loads(self._text(f"{folder}/_DONE"))}

    def _table(self, folder: str, table: str) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self._text(f"{folder}/_DONE"))[table])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{table}")

    def commit(self, run: str) -> int:
        """Make all steps of a run visible at once; a run that is committed already keeps its number."""
        while True:
            done = self.commits()
            if run in done:
                return done.index(run)
            if self._create(f"commits/{len(done):08d}", run):
                return len(done)

    def commits(self) -> list[str]:
        """Committed runs, oldest first."""
        return [self._text(f"commits/{n}") for n in self._names("commits")]

    def latest(self) -> str | None:
        """The last committed run; read all tables of one reading by the same id, as others may commit meanwhile."""
        done = self.commits()
        return done[-1] if done else None

    def read(self, run: str, step: str, table: str) -> DataFrame:
        """A table of a committed run."""
        if run not in self.commits():
            raise RunError(f"RUN_NOT_COMMITTED: {run}")
        return self._table(f"runs/{run}/{step}", table)

    def run(self, run: str, steps: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]) -> dict[str, DataFrame]:
        """All steps in order, each given the tables so far, and the commit.  The lock stays with a run that fails, until it is started again or released."""
        self.acquire(run)
        tables: dict[str, DataFrame] = {}
        for name, build in steps:
            tables |= self.step(run, name, lambda build=build: build(dict(tables)))
        self.commit(run)
        self.release(run)
        return tables
