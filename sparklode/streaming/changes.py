"""Streams: change events and the work they ask for, clipboard captures, and rule switches. Sessions with deadlines are in ``sessions``, the live index in ``overlays``.

Every stream writes idempotently per batch, so a batch that is tried again after a lost executor gives the same tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklode.functions import paths, text
from sparklode.operators import tree
from sparklode.plans import query as q
from sparklode.plans.compile import Options, term

EVENT = "event_id long, path string, flags int, received_at timestamp"


def events(spark: SparkSession, landing: str, baseline: int = 0, most_files: int = 100) -> DataFrame:
    """Change events from a landing folder; those up to the baseline are history (id 0 always counts)."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", most_files).parquet(landing)
    return rows.filter((F.col("event_id") == 0) | (F.col("event_id") > baseline))


def asked(batch: DataFrame) -> DataFrame:
    """(kind, path, event_id): what each event makes necessary; kind rescan where events were lost."""
    flags = F.col("flags")
    rows = batch.filter(F.col("path").isNotNull() & ~text.synthetic_path(F.col("path"))).withColumn("path", paths.canonical(F.col("path")))
    lost = flags.bitwiseAND(F.lit(text.RESCAN)) != 0
    kind = F.when(lost, "rescan").otherwise(text.event_class(flags))
    return rows.select(F.when(kind == "parent", "subtree").otherwise(kind).alias("kind"), F.when(kind == "parent", paths.parent(F.col("path"))).otherwise(F.col("path")).alias("path"), "event_id")


def collapsed(rows: DataFrame) -> DataFrame:
    """One row a path, the widest kind, without paths below a subtree."""
    level = F.when(F.col("kind") == "rescan", 3).when(F.col("kind") == "subtree", 2).when(F.col("kind") == "exact", 1).otherwise(0)
    one = rows.groupBy("path").agg(F.max_by("kind", level).alias("kind"), F.max("event_id").alias("event_id"))
    roots = tree.minimal_cover(one.filter("kind IN ('subtree', 'rescan')").select("path"))
    below = tree.covered_by(one, roots, strict=True).select("path").distinct()
    return one.join(below, "path", "left_anti").select("kind", "path", "event_id")


def batch_work(batch: DataFrame) -> DataFrame:
    """(kind, path, event_id) a batch asks for."""
    return collapsed(asked(batch))


def upserted(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Exact changes (path, event_id, present, ...) on a base with event ids: the last writer of a path wins, and tombstones go."""
    columns = base.columns
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("event_id")))
    every = base.withColumn("present", F.lit(True)).unionByName(batch.select(*columns, "present"))
    return every.withColumn("_n", last).filter("_n = 1 AND present").select(columns)


def retry_at(tries: Column) -> Column:
    """Seconds to wait after so many failures."""
    return F.least(F.lit(300), F.lit(5) * F.pow(F.lit(2), F.least(tries, F.lit(6)))).cast("int")


def retries(failed: DataFrame, before: DataFrame) -> DataFrame:
    """(path, tries, wait): what failed now, counted on from what failed before."""
    old = before.select("path", F.col("tries").alias("_t"))
    rows = failed.select("path").distinct().join(old, "path", "left")
    return rows.select("path", (F.coalesce("_t", F.lit(0)) + 1).alias("tries"), retry_at(F.coalesce("_t", F.lit(0))).alias("wait"))


def captured(stream: DataFrame, spark: SparkSession, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Clipboard captures (id, ts, content, app) merged into a history: one row a content, counts added up, versions by batch."""

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("copies"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{table}/v{number}"))
        new.groupBy("content_hash").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("copies").alias("copies")).write.mode("overwrite").parquet(f"{table}/v{number + 1}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def switches(matches: DataFrame) -> DataFrame:
    """(owner, ts, trigger_id) stream -> an action whenever the matching rule changes: start, switch or end. State is one value an owner."""

    def step(key, frames, state):
        at = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values("ts")
        out = []
        for ts, wanted in zip(rows["ts"], rows["trigger_id"], strict=True):
            wanted = None if pd.isna(wanted) else wanted
            if wanted != at:
                out.append((key[0], ts, "end" if wanted is None else "start" if at is None else "switch", wanted))
                at = wanted
        state.update((at,))
        yield pd.DataFrame(out, columns=["owner", "ts", "action", "trigger_id"])

    return matches.groupBy("owner").applyInPandasWithState(step, "owner string, ts timestamp, action string, trigger_id string", "trigger_id string", "append", "NoTimeout")


def refreshes(observed: DataFrame, text_: str, o: Options | None = None) -> DataFrame:
    """(batch, refresh) of batches of changes (batch, path, name, subtree): none, immediate or quiet (after a quiet period).

    ``name`` is what is there now, NULL if it is gone. A single plain word on names is tested on the names before and after; any other
    query, and a batch with a subtree, waits for a quiet period.
    """
    o = o or Options()
    node = q.parse(text_.strip())
    plain = isinstance(node, q.Term) and o.target == "name" and o.mode == "substring" and "/" not in text_ and not any(c.isspace() for c in text_.strip())
    if not plain:
        return observed.groupBy("batch").agg(F.lit("quiet").alias("refresh"))
    hit = lambda c: F.coalesce(term(node, c, o, o.pinyin), F.lit(False))
    old, new = paths.name(F.col("path")), F.col("name")
    return observed.groupBy("batch").agg(F.when(F.bool_or("subtree"), "quiet").when(F.bool_or(hit(old) | hit(new)), "immediate").otherwise("none").alias("refresh"))
