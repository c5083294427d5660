"""Session helpers: settings, and tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Settings that :func:`prepared` makes where the session still has Spark's own
#: value.  Whole documents are large rows, held several times over on their way
#: to Python, so an Arrow batch is bounded by rows and by bytes; shuffle files go
#: when the query that made them has ended; and filters reach sources in Python.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", str(4 << 20)),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
    "spark.sql.python.filterPushdown.enabled": ("false", "true"),
}


#: Python workers live through many tasks: arrays of 256 KB and more go back to the
#: system as soon as they are freed, instead of staying with the worker.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 18), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2"}


def prepared(spark: SparkSession) -> SparkSession:
    """Make ``SETTINGS`` in the caller's session, for good.

    And let Python workers on this machine import this package from where the
    driver has it (on a cluster ship it with ``--py-files`` as usual; the extra
    entry is harmless there)."""
    env = spark.sparkContext.environment
    env.update({k: v for k, v in WORKER_MEMORY.items() if k not in env})
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for name, (usual, wanted) in SETTINGS.items():
        now = spark.conf.get(name, usual)
        if now in (usual, f"{usual}b"):
            spark.conf.set(name, wanted)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal a table anew that has fewer splits than there are cores, for work
    that costs much more than reading.  A split is at most
    ``spark.sql.files.maxPartitionBytes``, so what this moves is bounded by that
    for each core; a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Deal a table anew into tasks of about so many rows, for rows that become many
    more: a file's bytes do not tell how many, so splits do not bound a task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and everything runs in one process (as in
    local tests) a temporary folder is made and set as the session's checkpoint
    folder; elsewhere executors would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="waybill-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def located(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop has them, whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    store, at = located(spark, path)
    store.delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes not to
    be a column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SWEPT: ContextVar[str | None] = ContextVar("swept", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here
    and a lost executor costs no recomputation of what came before."""
    return _written(df, f"{_SWEPT.get() or shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stored` leaves for operators' results go when the block ends;
    write what is to stay with :class:`Tables` made outside of it."""
    folder = f"{shared_dir(spark)}/swept-{uuid.uuid4().hex}"
    token = _SWEPT.set(folder)
    try:
        yield
    finally:
        _SWEPT.reset(token)
        delete(spark, folder)


class Tables:
    """Intermediate tables of one job in the shared folder; they go when the
    ``with`` block ends, and earlier where :meth:`drop` says so."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays when the block ends."""
        return _written(df, f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.paths)}"
        table = _written(df, path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, self.paths[id(table)][0])
