"""Usage history: opens by path, kept to the most recent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 500


def tallied(opens: DataFrame) -> DataFrame:
    """(path, ts) -> (path, open_count, last_opened)."""
    return opens.groupBy("path").agg(F.count("*").alias("open_count"), F.max("ts").alias("last_opened"))


def kept(usage: DataFrame, most: int = MOST) -> DataFrame:
    """The last opened; of equals the more often opened, then the smaller path. A top-k, not a sort of all."""
    return usage.orderBy(F.desc("last_opened"), F.desc("open_count"), "path").limit(most)


def repaired(records: DataFrame) -> DataFrame:
    """One record a path: the last opened wins, then the larger count."""
    best = F.max(F.struct("last_opened", "open_count")).alias("b")
    return records.groupBy("path").agg(best).select("path", "b.open_count", "b.last_opened")


def recent_queries(history: DataFrame, most: int = 10) -> DataFrame:
    """(query, ts) -> the last ``most`` different ones without regard to case, newest first."""
    nth = F.row_number().over(Window.partitionBy(F.lower("query")).orderBy(F.desc("ts"), "query"))
    return history.withColumn("_n", nth).filter("_n = 1").orderBy(F.desc("ts"), "query").limit(most).drop("_n")
