"""Stores of the engine as Parquet and JSON: snapshots, change journals, snippets, encrypted histories."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.sources import shared

SNAPSHOT_VERSION = 1
SNIPPETS = "version int, snippets array<struct<id:string,title:string,text:string,keyword:string,collection:string>>"


def save_snapshot(files: DataFrame, path: str, last_event: int) -> None:
    """A base snapshot; file names are dictionary-coded, and Bloom filters let searches for whole names skip row groups."""
    files.withColumn("version", F.lit(SNAPSHOT_VERSION)).withColumn("base_event_id", F.lit(last_event).cast("long")).write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true").option("compression", "zstd").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's rows; none if it has another version and must be built again."""
    return spark.read.parquet(path).filter(F.col("version") == SNAPSHOT_VERSION).drop("version")


def append_journal(changes: DataFrame, path: str, base_event: int) -> None:
    """(event_id, kind, path) after a base snapshot."""
    changes.withColumn("base_event_id", F.lit(base_event).cast("long")).write.mode("append").parquet(path)


def load_journal(spark: SparkSession, path: str, base_event: int, most: int | None = None) -> DataFrame:
    """The journal of exactly this base, whatever its size; nothing if it has grown over ``most`` changes, where a caller would rather build anew."""
    rows = spark.read.parquet(path).filter(F.col("base_event_id") == base_event)
    if most is None:
        return rows
    size = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(size)).filter(F.col("_n") <= most).drop("_n")  # one row


def import_snippets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SNIPPETS).option("multiLine", True).json(path)
    return rows.filter("version = 1").select(F.explode("snippets").alias("s")).select("s.id", "s.title", F.col("s.text").alias("preview"), "s.keyword", "s.collection")


def export_snippets(history: DataFrame) -> DataFrame:
    """One row with the archive as JSON, keys in order."""
    one = F.struct("collection", "id", "keyword", F.col("preview").alias("text"), "title")
    return history.filter("pinned").agg(F.array_sort(F.collect_list(one)).alias("snippets")).select(F.to_json(F.struct("snippets", F.lit(1).alias("version"))).alias("json"))


def save_usage(usage: DataFrame, path: str) -> None:
    """(path, open_count, last_opened): the last opened first, then by path; a bounded list (see ``usage.kept``)."""
    usage.orderBy(F.desc("last_opened"), "path").coalesce(1).write.mode("overwrite").parquet(path)


def load_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encrypted(history: DataFrame, key: str) -> DataFrame:
    """(id, payload): the row as JSON under AES-GCM; ``key`` has 16, 24 or 32 characters."""
    row = F.to_json(F.struct(*[c for c in history.columns if c != "id"]))
    return history.select("id", F.aes_encrypt(row, F.lit(key), F.lit("GCM")).alias("payload"))


def decrypted(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Rows that the key opens."""
    plain = F.try_aes_decrypt("payload", F.lit(key), F.lit("GCM")).cast("string")
    return rows.select("id", F.from_json(plain, schema).alias("r")).filter(F.col("r").isNotNull()).select("id", "r.*")


def changed_rows(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, ids to delete) that turn one history into the other."""
    upserts = new.join(old, [new[c].eqNullSafe(old[c]) for c in new.columns], "left_anti")
    return upserts, old.select("id").join(new.select("id"), "id", "left_anti")


class HistoryStore(Protocol):
    """Where a history is kept between sessions."""

    def load(self) -> DataFrame: ...

    def save(self, history: DataFrame) -> None: ...

    def remove(self) -> None: ...


class EncryptedStore:
    """A history (id, ...) as encrypted rows in two folders by turns, so that a save which breaks off leaves the last one whole.

    A save writes only rows that changed anew; the others are carried as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _turn(self) -> int:
        return max((int(n) for n in shared.names(self.spark, self.path) if "_SUCCESS" in shared.names(self.spark, f"{self.path}/{n}")), default=-1)

    def load(self) -> DataFrame:
        turn = self._turn()
        rows = self.spark.read.parquet(f"{self.path}/{turn}") if turn >= 0 else self.spark.createDataFrame([], "id string, payload binary")
        return decrypted(rows, self.key, self.schema)

    def save(self, history: DataFrame) -> None:
        turn = self._turn()
        old = self.load()
        up, gone = changed_rows(old, history.select(old.columns))
        new = encrypted(up, self.key)
        if turn >= 0:
            kept = self.spark.read.parquet(f"{self.path}/{turn}").join(up.select("id").union(gone), "id", "left_anti")
            new = new.unionByName(kept)
        new.write.mode("overwrite").parquet(f"{self.path}/{turn + 1}")
        if turn >= 0:
            shared.delete(self.spark, f"{self.path}/{turn}")

    def remove(self) -> None:
        shared.delete(self.spark, self.path)


def printed(results: DataFrame) -> DataFrame:
    """Lines of the command line: a path, and its preview below."""
    line = F.when(F.col("preview").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("\n    ↳ "), "preview"))
    return results.orderBy("rank").select(line.alias("value"))
