"""The log of change events: the newest events up to a capacity, and a search in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.functions import paths, text
from sparklode.operators.ranks import numbered
from sparklode.sources.shared import kept

CAPACITY = 20_000


def matching(events: DataFrame, words: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Events (event_id, flags, path) of the log whose keys and path hold all words (lower case)."""
    log = events.orderBy(F.desc("event_id")).limit(capacity)
    t = F.lower(F.concat_ws(" ", F.array_join(text.event_keys(F.col("flags")), " "), "path"))
    for w in words:
        log = log.filter(F.contains(t, F.lit(w)))
    return log


#: Columns that the table of events may be sorted by.
SORTS = {
    "time": lambda: F.col("ts"),
    "key": lambda: F.lower(F.array_join(text.event_keys(F.col("flags")), ", ")),
    "name": lambda: F.lower(paths.name(F.col("path"))),
    "location": lambda: F.lower(paths.parent(F.col("path"))),
}


def sorted_by(events: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Events (event_id, ts, flags, path) with ``position`` in the order of a column a user chose, then the newest first."""
    key = SORTS[by]()
    return numbered(events, [key.desc() if descending else key.asc(), F.desc("event_id")], kept, "position")


def last_id(events: DataFrame) -> DataFrame:
    return events.agg(F.max("event_id").alias("last_id"))
