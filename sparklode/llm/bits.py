"""A bit table of fixed size over ids: rows whose bit is off are surely not among them.

It spares most rows of a large table the exchange before a join, whatever the size of the input; the join itself decides. The table has
at most BITS / 64 rows of 64 bits, so it may be broadcast; looking a row up is a hash join in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import materialize

BITS = 1 << 24


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))


def bit_table(ids: DataFrame) -> DataFrame:
    """(_at, _word): the words of the table that have a bit for an id in the first column, a long."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int"))
    words = ids.select(_bit(ids.columns[0]).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_at")).agg(F.bit_or(one).alias("_word"))
    return materialize(words, "bits")


def maybe_in(rows: DataFrame, column: str, table: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose bit is on (off: ``inside`` False); all columns are kept."""
    row = rows.select(F.struct("*").alias("_row"), _bit(column).alias("_bit")).withColumn("_at", F.shiftright("_bit", 6))
    on = F.coalesce(F.getbit("_word", (F.col("_bit") % 64).cast("int")) == 1, F.lit(False))
    return row.join(F.broadcast(table), "_at", "left").filter(on if inside else ~on).select("_row.*")
