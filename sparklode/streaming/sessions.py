"""Sessions with deadlines, and a capture history that expires: state by key with event-time timers.

A key's rows are taken in order of time, and what falls due before a row comes before it; a timer ends what falls due while a key is
quiet. So the rows that come out don't depend on how the input is cut into batches, as long as no row is older than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COMMAND = "owner string, ts timestamp, seq long, kind string, id string, seconds double"
ACTION = "owner string, ts timestamp, action string, source string, id string, reason string"
ENTRY = "content_hash string, first_at timestamp, last_at timestamp, copies long"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and several state variables need, while a query is started."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Sessions(StatefulProcessor):
    """One session an owner at most, begun by hand or by a rule.

    Commands by kind. "start": a session by hand for ``seconds`` (NULL: without end); one that runs is replaced. "extend": a running
    session with a deadline gets ``seconds`` more. "end": the running one ends on request; if a rule began it, rules stay off until
    "enable". "match": ``id`` is the first rule that matches, or NULL: a rule's session starts, switches to another rule's, or ends; a
    session begun by hand is left alone. At its deadline a session ends by itself.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "source string, id string, deadline long")
        self.rules = handle.getValueState("rules", "enabled boolean")

    def _take(self) -> tuple[list | None, bool]:
        now = self.running.get() if self.running.exists() else None
        return (list(now) if now is not None else None), (self.rules.get()[0] if self.rules.exists() else True)

    def _put(self, now: list | None, enabled: bool) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if now is None:
            self.running.clear()
        else:
            self.running.update(tuple(now))
            if now[2] is not None:
                self.handle.registerTimer(now[2])
        self.rules.update((enabled,))

    def handleInputRows(self, key, rows, timerValues):
        owner, out = key[0], []
        now, enabled = self._take()
        every = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        for ts, kind, name, seconds in zip(every["ts"], every["kind"], every["id"], every["seconds"], strict=True):
            name, seconds, ms = (None if pd.isna(name) else name), (None if pd.isna(seconds) else float(seconds)), _ms(ts)
            say = lambda action, s, why=None, at=ts: out.append((owner, at, action, s[0], s[1], why))
            if now is not None and now[2] is not None and now[2] <= ms:
                say("end", now, "deadline", _at(now[2]))
                now = None
            if kind == "start":
                begun = ["manual", name, None if seconds is None else ms + int(seconds * 1000)]
                say("start" if now is None else "replace", begun)
                now = begun
            elif kind == "extend":
                if now is not None and now[2] is not None and seconds is not None and seconds > 0:
                    now[2] += int(seconds * 1000)
                    say("extend", now)
            elif kind == "end":
                if now is not None:
                    say("end", now, "requested")
                    enabled = enabled and now[0] != "trigger"
                    now = None
            elif kind == "enable":
                enabled = True
            elif kind == "match":
                wanted = name if enabled else None
                if now is None:
                    if wanted is not None:
                        now = ["trigger", wanted, None]
                        say("start", now)
                elif now[0] == "trigger" and wanted != now[1]:
                    if wanted is None:
                        say("end", now, "condition")
                        now = None
                    else:
                        now = ["trigger", wanted, None]
                        say("replace", now)
        self._put(now, enabled)
        yield pd.DataFrame(out, columns=["owner", "ts", "action", "source", "id", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, enabled = self._take()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if now is None or now[2] != at:
            return
        self.running.clear()
        yield pd.DataFrame([(key[0], _at(at), "end", now[0], now[1], "deadline")], columns=["owner", "ts", "action", "source", "id", "reason"])

    def close(self) -> None:
        pass


def _typed(schema: str, spark: SparkSession) -> StructType:
    return spark.createDataFrame([], schema).schema


def sessions(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of commands (COMMAND) -> actions (ACTION). Rows older than the watermark, ``late`` behind the newest, are dropped."""
    keyed = commands.withWatermark("ts", late).groupBy("owner")
    return keyed.transformWithStateInPandas(Sessions(), _typed(ACTION, commands.sparkSession), "Append", "EventTime")


class History(StatefulProcessor):
    """Entries by content, in a map: copies of a content within the retention are one entry, which goes when the retention is over."""

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "content_hash string", "first_at long, last_at long, copies long")

    def _row(self, content: str, entry: tuple) -> tuple:
        return content, _at(entry[0]), _at(entry[1]), int(entry[2])

    def handleInputRows(self, key, rows, timerValues):
        out, held = [], {}
        every = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        for content, ts in zip(every["content_hash"], every["ts"], strict=True):
            ms = _ms(ts)
            if content not in held:
                held[content] = tuple(self.entries.getValue((content,))) if self.entries.containsKey((content,)) else None
            e = held[content]
            if e is not None and e[1] + self.retention < ms:
                out.append(self._row(content, e))
                e = None
            held[content] = (ms, ms, 1) if e is None else (e[0], ms, e[2] + 1)
        for content, e in held.items():
            self.entries.updateValue((content,), e)
            self.handle.registerTimer(e[1] + self.retention)
        yield pd.DataFrame(out, columns=["content_hash", "first_at", "last_at", "copies"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for content, entry in list(self.entries.iterator()):
            if entry[1] + self.retention <= at:
                out.append(self._row(content[0], tuple(entry)))
                self.entries.removeKey(content)
        yield pd.DataFrame(out, columns=["content_hash", "first_at", "last_at", "copies"])

    def close(self) -> None:
        pass


def expired(captures: DataFrame, retention_ms: int, groups: int = 1024, late: str = "0 seconds") -> DataFrame:
    """A stream of captures (content_hash, ts) -> entries (ENTRY) as they leave the history. Contents share ``groups`` keys of the state."""
    from pyspark.sql import functions as F

    rows = captures.select("content_hash", "ts", F.pmod(F.xxhash64("content_hash"), F.lit(groups)).alias("part")).withWatermark("ts", late)
    return rows.groupBy("part").transformWithStateInPandas(History(retention_ms), _typed(ENTRY, captures.sparkSession), "Append", "EventTime")


def written(rows: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream of one of these into a Parquet table."""
    with state_store(rows.sparkSession):
        return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()
