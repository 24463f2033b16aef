"""A live index: a base in ranges of paths, and a log of what was looked at since.

A batch of change events asks for paths to be looked at again. What is found goes into a log named by the batch: roots of subtrees that
were scanned, holes in them that couldn't be listed, rows found, and single paths with whether they are there. For every path the newest
entry that covers it decides; a scan of a subtree covers all below its root but what lies at or below its holes. So a newer scan
replaces older entries inside it, except in its holes, and a path there keeps what an older entry or the base says.

The base lies in buckets, ranges of paths, listed in a manifest. Reading joins only the buckets that the log reaches; compaction writes
those anew and leaves the others. A batch writes to folders of its number, its state last, so that a batch tried again gives the same.

Layout: ``base/gen=G/bucket=B``, ``manifest/v=G`` (bucket, low, gen), ``roots|holes|rows|retry|state/batch=N``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklode.functions.paths import ancestors
from sparklode.sources import shared
from sparklode.streaming import changes

#: Compaction: as many single paths, or rows of scanned subtrees, in the log.
EXACT_MOST, SUBTREE_MOST = 30_000, 100_000
#: Batches whose changes can be asked for.
HISTORY = 16
#: ``look(work)``: work (kind, path, event_id) with kind subtree or exact; gives found rows (root, present, is_complete, and the columns
#: of the base; root is the path of the work) and holes (root, hole).
Look = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
STATE = "batch long, seen long, checkpoint long, pending long, log_from long, gen long"


def covering(paths: DataFrame, roots: DataFrame, holes: DataFrame) -> DataFrame:
    """(path, batch): the newest scan that covers each path; ``roots`` (root, batch), ``holes`` (root, batch, hole). Only paths below a root are joined to holes."""
    hits = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots, "root")
    spared = hits.select("path", "root", "batch", F.explode(ancestors(F.col("path"))).alias("hole")).join(holes, ["root", "batch", "hole"], "left_semi")
    return hits.join(spared, ["path", "root", "batch"], "left_anti").groupBy("path").agg(F.max("batch").alias("batch"))


class LiveIndex:
    """The tables of one live index under ``at``."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._known: tuple[dict[str, int] | None, tuple[int, list[tuple[int, str, int]]] | None] = (None, None)  # the last state and manifest read

    # ------------------------------------------------------------ base

    def create(self, base: DataFrame, buckets: int = 32) -> None:
        """Write the base in ranges of ``path``."""
        dealt = shared.kept(base.repartitionByRange(buckets, "path").withColumn("bucket", F.spark_partition_id()), "ranges")
        dealt.repartition("bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/base/gen=0")
        low = dealt.groupBy("bucket").agg(F.min("path").alias("low"))  # a row a bucket
        self._manifest(0, [(r["bucket"], r["low"], 0) for r in low.collect()])
        self._write_state(-1, 0, 0, 0, 0, 0)

    def _manifest(self, gen: int, rows: list[tuple[int, str, int]]) -> None:
        self.spark.createDataFrame(rows, "bucket int, low string, gen long").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/v={gen}")

    def manifest(self, gen: int) -> list[tuple[int, str, int]]:
        """(bucket, low, gen) by range: as many rows as there are buckets."""
        if self._known[1] is None or self._known[1][0] != gen:
            rows = sorted(map(tuple, self.spark.read.parquet(f"{self.at}/manifest/v={gen}").collect()), key=lambda r: r[1])
            self._known = (self._known[0], (gen, rows))
        return self._known[1][1]

    def _base(self, part: list[tuple[int, str, int]]) -> list[DataFrame]:
        """The rows of some buckets: a read for each generation, which names its buckets' folders."""
        out = []
        for gen in sorted({g for *_, g in part}):
            folder = f"{self.at}/base/gen={gen}"
            there = set(shared.names(self.spark, folder))
            at = [f"{folder}/bucket={b}" for b, _, g in part if g == gen and f"bucket={b}" in there]
            if at:
                out.append(self.spark.read.option("basePath", folder).parquet(*at).drop("bucket"))
        return out

    # ------------------------------------------------------------ log

    def _write_state(self, *row: int) -> None:
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/state/n={row[0]}")
        self._known = (None, self._known[1])

    def state(self) -> dict[str, int]:
        """That of the last batch that was written to its end."""
        last = max(int(n.split("=")[1]) for n in shared.names(self.spark, f"{self.at}/state") if n.startswith("n="))
        return self._state_of(last)

    def _state_of(self, batch: int) -> dict[str, int]:
        if self._known[0] is None or self._known[0]["batch"] != batch:
            self._known = (self.spark.read.schema(STATE).parquet(f"{self.at}/state/n={batch}").head().asDict(), self._known[1])
        return self._known[0]

    def _log(self, name: str, schema: str, first: int, last: int) -> DataFrame:
        """Log entries of batches ``first`` to ``last``, with ``batch``."""
        there = set(shared.names(self.spark, f"{self.at}/{name}"))
        at = [f"{self.at}/{name}/batch={n}" for n in range(first, last + 1) if f"batch={n}" in there]
        if not at:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.option("basePath", f"{self.at}/{name}").parquet(*at).withColumn("batch", F.col("batch").cast("long"))

    def logs(self, first: int, last: int, columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(roots, holes, rows) of batches; ``columns``: the schema of the base."""
        return self._log("roots", "root string", first, last), self._log("holes", "root string, hole string", first, last), self._log("rows", f"{columns}, present boolean, exact boolean", first, last)

    def _columns(self, manifest: list[tuple[int, str, int]]) -> str:
        one = next(iter(self._base(manifest)), None)
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema)

    @staticmethod
    def _bucket_of(path: Column, manifest: list[tuple[int, str, int]]) -> Column:
        """The place in the manifest of the range that holds a path."""
        lows = F.array(*(F.lit(low) for _, low, _ in manifest))
        return F.greatest(F.size(F.filter(lows, lambda low: low <= path)) - 1, F.lit(0))

    def _reached(self, roots: DataFrame, rows: DataFrame, manifest: list[tuple[int, str, int]]) -> set[int]:
        """Places in the manifest of the ranges that log entries reach; at most as many as there are buckets."""
        place = lambda c: self._bucket_of(c, manifest)
        of_roots = roots.select(F.explode(F.sequence(place(F.col("root")), place(F.concat("root", F.lit("0"))))).alias("b"))
        return {r["b"] for r in of_roots.union(rows.select(place(F.col("path")).alias("b"))).distinct().collect()}

    def _merged(self, state: dict[str, int], last: int) -> tuple[DataFrame, list[DataFrame], list[tuple[int, str, int]], set[int]]:
        """(rows of the ranges the log reaches, as they are now; rows of the others; the manifest; places reached)."""
        manifest = self.manifest(state["gen"])
        roots, holes, rows = self.logs(state["log_from"], last, self._columns(manifest))
        columns = [c for c in rows.columns if c not in ("present", "exact", "batch")]
        reached = self._reached(roots, rows, manifest)
        old = self._base([m for k, m in enumerate(manifest) if k in reached])
        other = self._base([m for k, m in enumerate(manifest) if k not in reached])
        single = rows.filter("exact").groupBy("path").agg(F.max("batch").alias("batch"))
        every = reduce(DataFrame.unionByName, [d.select("path") for d in old], rows.select("path")).distinct()
        newest = covering(every, roots, holes).unionByName(single).groupBy("path").agg(F.max("batch").alias("batch"))
        mine = rows.join(newest, ["path", "batch"], "left_semi").filter("present").select(columns)
        left = [d.join(newest, "path", "left_anti").select(columns) for d in old]
        return reduce(DataFrame.unionByName, left, mine), other, manifest, reached

    def visible(self) -> DataFrame:
        """All rows as they are known now."""
        state = self.state()
        merged, other, _, _ = self._merged(state, state["batch"])
        return reduce(DataFrame.unionByName, other, merged)

    def changed_since(self, batch: int) -> DataFrame | None:
        """(path, subtree) looked at after ``batch``; None if that is longer ago than the history goes, so that all must be read again."""
        state = self.state()
        if state["batch"] - batch > HISTORY or batch < -1:
            return None
        roots, _, rows = self.logs(batch + 1, state["batch"], "path string")
        return roots.select(F.col("root").alias("path"), F.lit(True).alias("subtree")).union(rows.filter("exact").select("path", F.lit(False))).distinct()

    # ------------------------------------------------------------ batches

    def apply(self, batch: DataFrame, number: int, look: Look, exact_most: int = EXACT_MOST, subtree_most: int = SUBTREE_MOST) -> None:
        """Look at what a batch of events asks for, and at what is due to be tried again; log it, and compact a log that has grown."""
        before = self._state_of(number - 1)
        asked = changes.asked(batch)
        head = batch.agg(F.max("event_id"), F.max("received_at")).head()
        waiting = self._log("retry", "kind string, path string, event_id long, tries int, next_at timestamp", number - 1, number - 1).drop("batch")
        now = F.lit(head[1]) if head[1] is not None else F.current_timestamp()
        due = waiting.filter(F.col("next_at") <= now)
        work = self._kept(changes.collapsed(asked.unionByName(due.select("kind", "path", "event_id"))), "work", number)
        subtree = F.col("kind").isin("subtree", "rescan")
        work = work.withColumn("kind", F.when(subtree, "subtree").otherwise("exact"))
        found, holes = look(work)
        holes = self._kept(holes.select("root", "hole"), "holes", number)
        lost = holes.filter("root = hole").select(F.col("root").alias("path"))  # the root itself couldn't be listed: no scan
        roots = self._kept(work.filter("kind = 'subtree'").join(lost, "path", "left_anti").select(F.col("path").alias("root")), "roots", number)
        single = work.filter("kind = 'exact'").select(F.col("path").alias("root"), F.lit(True).alias("exact"))
        target = roots.select("root", F.lit(False).alias("exact")).unionByName(single)
        rows = found.join(target, "root").filter("is_complete AND (present OR exact)")
        below = covering(rows.filter("NOT exact").select("path"), holes.select(F.col("hole").alias("root"), F.lit(0).alias("batch")), holes.filter("false").select("root", "hole", F.lit(0).alias("batch"))).select("path")
        rows = rows.join(below, "path", "left_anti") if not holes.isEmpty() else rows
        rows = self._kept(rows.drop("root", "is_complete"), "rows", number)

        # What couldn't be looked at is tried again: holes as subtrees, and single paths. Entries that aren't due wait, unless a scan came by.
        done = rows.filter("exact").select("path")
        failed = holes.select(F.lit("subtree").alias("kind"), F.col("hole").alias("path")).unionByName(work.filter("kind = 'exact'").join(done, "path", "left_anti").select("kind", "path")).distinct()
        passed = covering(waiting.select("path"), roots.withColumn("batch", F.lit(0)), holes.withColumn("batch", F.lit(0))).select("path").union(done)
        tries = F.coalesce(F.col("tries"), F.lit(0))
        again = failed.join(waiting.drop("kind"), "path", "left").select("kind", "path", F.coalesce("event_id", F.lit(head[0] or 0)).alias("event_id"), (tries + 1).alias("tries"), F.timestamp_add("SECOND", changes.retry_at(tries), now).alias("next_at"))
        later = waiting.filter(F.col("next_at") > now).join(passed, "path", "left_anti").join(failed, "path", "left_anti")
        retry = self._kept(again.unionByName(later.select(again.columns)), "retry", number)

        pending, seen = retry.count(), max(before["seen"], head[0] or 0)
        checkpoint = seen if pending == 0 else before["checkpoint"]
        state = (number, seen, checkpoint, pending, before["log_from"], before["gen"])
        counts = self.logs(before["log_from"], number, self._columns(self.manifest(before["gen"])))[2].agg(F.count_if("exact"), F.count_if(~F.col("exact"))).head()
        if counts[0] > exact_most or counts[1] > subtree_most:
            state = (*state[:4], number + 1, self._compacted(before, number))
        self._write_state(*state)
        self._forget(number, before)

    def _kept(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        at = f"{self.at}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _compacted(self, state: dict[str, int], number: int) -> int:
        """Write the ranges that the log reaches anew as generation ``number + 1``."""
        merged, _, manifest, reached = self._merged(state, number)
        gen = number + 1
        ids = F.array(*(F.lit(b) for b, _, _ in manifest))
        out = merged.withColumn("bucket", F.get(ids, self._bucket_of(F.col("path"), manifest)))
        out.repartition("bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/base/gen={gen}")
        self._manifest(gen, [(b, low, gen if k in reached else g) for k, (b, low, g) in enumerate(manifest)])
        return gen

    def _forget(self, number: int, before: dict[str, int]) -> None:
        """Delete what neither this state, nor the one before (if this batch is tried again), nor the history needs."""
        gens = {before["gen"], self.state()["gen"]}
        used = {g for gen in gens for *_, g in self.manifest(gen)}
        first = min(before["log_from"], number - HISTORY)
        needed = {"base": lambda n: n in used, "manifest": lambda n: n in gens, "state": lambda n: n >= number - 1}
        needed |= dict.fromkeys(("work", "roots", "holes", "rows"), lambda n: n >= first) | {"retry": lambda n: n >= number - 1}
        for name, keep in needed.items():
            for found in shared.names(self.spark, f"{self.at}/{name}"):
                if "=" in found and not keep(int(found.split("=")[1])):
                    shared.delete(self.spark, f"{self.at}/{name}/{found}")

    def maintain(self, stream: DataFrame, checkpoint: str, look: Look, trigger: dict | None = None, **most: int) -> StreamingQuery:
        """Keep the index current from a stream of change events."""
        apply = lambda batch, number: self.apply(batch, number, look, **most)
        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "700 milliseconds"})).start()


# ---------------------------------------------------------------- freshness

def last_change(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (path, ...) with ``changed``: the last event id among changes (kind, path, event_id) of the path, or of a subtree at or above it; NULL without any."""
    deep = asked.filter("kind IN ('subtree', 'rescan')").groupBy("path").agg(F.max("event_id").alias("event_id"))
    single = asked.groupBy("path").agg(F.max("event_id").alias("event_id"))
    below = rows.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("_root")).join(deep.withColumnRenamed("path", "_root"), "_root").select("path", "event_id")
    last = below.union(single.select("path", "event_id")).groupBy("path").agg(F.max("event_id").alias("changed"))
    return rows.join(last, "path", "left")


def freshness(rows: DataFrame, asked: DataFrame, reconciled: int, unresolved: DataFrame) -> DataFrame:
    """``rows`` with ``fresh``: whether a row may be returned without looking at its path.

    An event revokes it for what it covers. Once all events up to ``reconciled`` have been looked at it holds again, but for what lies
    at or below an ``unresolved`` path (path), however few those are.
    """
    open_ = asked.filter(F.col("event_id") > reconciled)
    changed = last_change(rows, open_.unionByName(unresolved.select(F.lit("subtree").alias("kind"), "path", F.lit(0).cast("long").alias("event_id"))))
    return changed.withColumn("fresh", F.col("changed").isNull()).drop("changed")


def content_kept(meta: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of a content index (path, indexed, ...) that no later change covers: the others must be read again."""
    return last_change(meta, asked).filter(F.coalesce(F.col("changed") <= F.col("indexed"), F.lit(True))).drop("changed")
