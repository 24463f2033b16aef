"""Order-dependent computations: rates, stalls, sessions, pairs and typing buffers. Each is partitioned by a key, never one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cpu_percent(samples: DataFrame, key: str = "host") -> DataFrame:
    """(key, ts, active, total) counters -> percent between consecutive samples, clamped; NULL first and where the total doesn't grow."""
    w = Window.partitionBy(key).orderBy("ts", "sample_id")
    da, dt = F.col("active") - F.lag("active").over(w), F.col("total") - F.lag("total").over(w)
    return samples.withColumn("percent", F.when(dt > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * da / dt))))


def stalled(samples: DataFrame, timeout: float, key: str = "path") -> DataFrame:
    """(key, ts, size, modified) -> with ``stalled``: nothing changed for at least ``timeout`` seconds."""
    w = Window.partitionBy(key).orderBy("ts", "sample_id")
    same = F.col("size").eqNullSafe(F.lag("size").over(w)) & F.col("modified").eqNullSafe(F.lag("modified").over(w))
    rows = samples.withColumn("_same", same).withColumn("_at", F.when(~F.col("_same") | (F.row_number().over(w) == 1), F.col("ts")))
    since = F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stalled", F.col("ts").cast("double") - since.cast("double") >= timeout).drop("_same", "_at")


def poll_interval(timeout: float) -> float:
    return min(max(timeout / 4, 0.01), 2.0)


def session_stats(events: DataFrame, now, key: str = "owner") -> DataFrame:
    """(key, ts, event, event_id): started opens an interval, replaced goes on with it, ended closes it; what is open counts up to ``now``."""
    e = events.filter(F.col("event").isin("started", "ended"))
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    e = e.withColumn("_next", F.lead("event").over(w)).withColumn("_until", F.lead("ts").over(w)).withColumn("_prev", F.lag("event").over(w))
    opened = e.filter((F.col("event") == "started") & ~F.coalesce(F.col("_prev") == "started", F.lit(False)))
    # A second start without an end goes on with the open interval, so the end is that of the next "ended".
    ends = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    close = e.withColumn("_end", F.last(F.when(F.col("event") == "ended", F.col("ts")), ignorenulls=True).over(ends)).select(key, "event_id", "_end")
    spans = opened.join(close, [key, "event_id"]).withColumn("_s", F.coalesce("_end", F.lit(now)).cast("double") - F.col("ts").cast("double"))
    return spans.groupBy(key).agg(F.count("*").alias("sessions"), F.round(F.sum("_s"), 6).alias("seconds"), F.round(F.sum("_s") / F.count("*"), 6).alias("average"))


def merge_pairs(copies: DataFrame, gap: float = 0.85, key: str = "process") -> DataFrame:
    """(key, ts, event_id) -> pairs of consecutive copies within ``gap`` seconds; a copy is in one pair at most.

    In a chain of copies each within the gap of the one before, the first pairs with the second, the third with the fourth, and so on.
    So a row's place in its chain decides, and no fold is needed.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    near = F.coalesce(F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") <= gap, F.lit(False))
    rows = copies.withColumn("_new", (~near).cast("int")).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(key, "_chain").orderBy("ts", "event_id")
    rows = rows.withColumn("_n", F.row_number().over(chain)).withColumn("first_id", F.lag("event_id").over(chain))
    return rows.filter(F.col("_n") % 2 == 0).select(key, "first_id", F.col("event_id").alias("second_id"))


def typing_sessions(keys: DataFrame, gap: float = 10.0, most: int = 64, key: str = "user_id") -> DataFrame:
    """(key, ts, event_id, process, letter) -> what is in the buffer at the end of each run: a new process or a pause starts anew, a backspace removes."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = ~F.coalesce((F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") <= gap) & (F.col("process") == F.lag("process").over(w)), F.lit(False))
    rows = keys.withColumn("_run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "letter"))).alias("_k"))
    drop = lambda s: F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
    text = F.aggregate("_k", F.lit(""), lambda s, x: F.when(x["letter"] == "\b", drop(s)).otherwise(F.right(F.concat(s, x["letter"]), F.lit(most))))
    return runs.select(key, F.col("_run").cast("long").alias("run"), F.size("_k").cast("long").alias("n"), text.alias("buffer"))


def flips(states: DataFrame, key: str = "owner") -> DataFrame:
    """Rows where a boolean differs from the one before; the first row counts."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return states.withColumn("_before", F.lag("state").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("state"))).drop("_before")


def screen_locks(ticks: DataFrame, threshold: float, key: str = "owner") -> DataFrame:
    """(key, ts, event_id, idle_s, locked) -> the ticks at which the screen is to be locked: the first in an idle period whose idle time reaches the threshold.

    A period ends with a tick at which the screen isn't locked and the idle time is below the threshold.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    long = F.col("idle_s") >= threshold
    rows = ticks.withColumn("_period", F.sum((~F.col("locked") & ~long).cast("int")).over(w)).filter(long)
    first = F.row_number().over(Window.partitionBy(key, "_period").orderBy("ts", "event_id"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_period", "_n")


def repaired_pins(history: DataFrame, keys: str) -> DataFrame:
    """(id, created_at, pin_key) of pinned rows with their keys made unique: of equal keys the first row keeps it, rows without one get the
    free keys in order, and there are no more keys than letters in ``keys``: rows beyond have none."""
    pinned = history.filter("pinned").select("id", "created_at", "pin_key")
    known = F.col("pin_key").isin(list(keys))
    keeps = pinned.filter(known).groupBy("pin_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("_id")).select("_id", F.col("pin_key").alias("_key"))  # a row a key
    free = [k for k in keys if k not in {r["_key"] for r in keeps.collect()}]
    rows = pinned.join(F.broadcast(keeps), F.col("id") == F.col("_id"), "left").drop("_id", "pin_key")
    # The first rows without a key meet the free keys by rank; both are at most as many as there are keys.
    ids = [r["id"] for r in rows.filter("_key IS NULL").orderBy("created_at", "id").limit(len(free)).select("id").collect()]
    given = history.sparkSession.createDataFrame(list(zip(ids, free, strict=False)), "id string, _given string")
    return rows.join(F.broadcast(given), "id", "left").select("id", "created_at", F.coalesce("_key", "_given").alias("pin_key"))
