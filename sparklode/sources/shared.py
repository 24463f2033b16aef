"""The folder that the driver and all executors share: for tables that cut a plan, and for the logs of streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

#: Tables that results may still be read from; they go when the program ends.
_LEFT: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """As the session names it in ``spark.checkpoint.dir``; a folder of this machine only where all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sparklode-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """The path of a new folder there, which is deleted when the program ends."""
    at = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[at] = spark
    return at


def kept(rows: DataFrame, label: str = "kept") -> DataFrame:
    """Rows written there and read again."""
    at = fresh(rows.sparkSession, label)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_left() -> None:
    for at, spark in _LEFT.items():
        try:
            delete(spark, at)
        except (Py4JError, Py4JNetworkError, AttributeError, OSError):  # the session has ended before
            return


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
