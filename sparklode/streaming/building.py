"""Partial results of a build that is still running: batches of rows as they are written, published as a snapshot that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklode.operators.tree import first_by_path
from sparklode.sources import shared

#: Rows published while building, at most by whole batches; what is beyond waits for the build to end (:func:`ended`). Milliseconds between publications.
MOST, APART = 250_000, 300


def published(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, most: int = MOST) -> StreamingQuery:
    """Rows (path, node_id, ...) that a build appends, as ``table/batch=N``: each path once, in the batch that first had it.

    A batch is published while fewer than ``most`` rows are; the others wait as ``table/waiting/batch=N``. A batch tried again writes the same
    rows to the same folder.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = snapshot(spark, table, batch.schema.simpleString(), number)
        at = f"{table}/batch={number}" if before.count() < most else f"{table}/waiting/batch={number}"
        _new(batch, before).write.mode("overwrite").parquet(at)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{APART} milliseconds"})).start()


def _new(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Each path of ``rows`` once, without those published before; a null path is one like others."""
    old = before.select(F.col("path").alias("_old"))
    return first_by_path(rows).join(old, F.col("path").eqNullSafe(F.col("_old")), "left_anti")


def ended(spark: SparkSession, table: str, schema: str) -> None:
    """The build has ended: what waited is published as one more batch. Doing it again writes the same rows to the same folder."""
    numbers = [int(n[6:]) for n in shared.names(spark, f"{table}/waiting") if n.startswith("batch=")]
    if numbers:
        number = max(numbers) + 1
        waiting = snapshot(spark, f"{table}/waiting", schema).drop("batch")
        _new(waiting, snapshot(spark, table, schema, number)).write.mode("overwrite").parquet(f"{table}/batch={number}")


def snapshot(spark: SparkSession, table: str, schema: str, before: int | None = None) -> DataFrame:
    """What is published so far, with its ``batch``; ``before``: by earlier batches only."""
    at = [n for n in shared.names(spark, table) if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
    if not at:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.option("basePath", table).parquet(*(f"{table}/{n}" for n in at)).withColumn("batch", F.col("batch").cast("long"))
