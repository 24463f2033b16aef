"""Cutting lineage in the shared folder, and reading tables; used by the operators that need more than one pass."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

#: Tables that results may still be read from, also those of an operator that failed; they go when the program ends.
_LEFT: dict[str, SparkSession] = {}
#: While a table is written: its query's shuffle files go when it has ended, as nobody reads them again.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that a Python worker gets at once, where the session leaves Spark's number: ten thousand long texts fill an executor.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", ("10000", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a folder of this machine only where all runs in one process (as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sparklode-")
        spark.sparkContext.setCheckpointDir(at)
    return at


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of :data:`WRITING`, for a while."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def in_batches(df: DataFrame) -> DataFrame:
    """The same table; from here on the session's Python workers get batches of bounded memory."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == ROWS[0]:
        conf.set(BATCH, ROWS[1])
    return df


def eased(spark: SparkSession) -> None:
    """Plans, broadcasts and shuffles of passes that have ended go from a driver whose heap is half full of them, before it grows."""
    java = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * (java.totalMemory() - java.freeMemory()) > java.maxMemory():
        java.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its rows survive lost executors, and later reads prune columns."""
    return Tables(df.sparkSession).keep(df, label)


class Tables:
    """Tables in the shared folder that one operator needs for a while; :meth:`drop` deletes those that are used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _LEFT[path] = self.spark
        with writing(self.spark):
            df.write.parquet(path)
        eased(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; no DataFrame made from them may be run after this."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            _delete(self.spark, path)
            _LEFT.pop(path, None)

    def drop_all(self) -> None:
        self.drop(*(t for t, _ in list(self.paths.values())))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_left() -> None:
    for path, spark in _LEFT.items():
        try:
            _delete(spark, path)
        except (Py4JError, Py4JNetworkError, AttributeError, OSError):  # the session has ended before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
