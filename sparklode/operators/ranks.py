"""Ranks and running totals over a global order, without a window that puts a large group (or everything) in one task.

Rows are dealt by ranges of the order and written, so that each knows its piece for good (ranges are sampled, and a second run may cut
elsewhere). A window inside each piece gives local values; what earlier pieces add to a group that goes on is a total a piece. A piece
begins with one group, so these totals are at most as many rows as there are pieces, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "_piece"
Derive = Callable[[DataFrame], DataFrame]
#: How a running value is made in a piece, and joined to that of earlier pieces.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda earlier, here: F.coalesce(earlier, F.lit(0)) + here),
    "xor": (F.bit_xor, lambda earlier, here: F.coalesce(earlier, F.lit(0)).bitwiseXOR(here)),
    "min": (F.min, lambda earlier, here: F.least(earlier, here)),
}


class Pieces:
    """Rows in pieces of the order (group, order).

    ``group``: columns that hold no NULL, ascending. ``order``: sort columns inside a group. ``keep`` writes a table where all executors
    read it and gives it back. Rows that are equal in all of these are dealt by no rule, and their values are told apart at random.
    """

    def __init__(self, rows: DataFrame, group: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame]):
        self.group, self.order = group, order
        # The last sort column lets many equal rows be cut, too.
        dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie")
        self.rows = keep(dealt.withColumn(PIECE, F.spark_partition_id()))

    def _edge(self) -> DataFrame:
        """Rows of the groups that a piece begins with: those that may have begun in an earlier one."""
        first = self.group[0]
        low = self.rows.groupBy(PIECE).agg(F.min(first).alias("_low")).select("_low").distinct()
        return self.rows.join(F.broadcast(low), F.col(first) == F.col("_low"), "left_semi")  # a row a piece

    def running(self, values: Mapping[str, tuple[str, Column]], derive: Derive = lambda r: r, rows: DataFrame | None = None, more: str | None = None) -> DataFrame:
        """``derive(rows)`` with running values: name -> (kind, column), up to and with each row.

        ``derive`` adds columns to rows of this order (it may use :meth:`running` on the rows it is given). ``more`` names a column that
        says whether the group goes on after the row.
        """
        inside = Window.partitionBy(PIECE, *self.group).orderBy(*self.order, "_tie")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        totals = derive(self._edge()).groupBy(PIECE, *self.group).agg(*(KINDS[kind][0](c).alias(n) for n, (kind, c) in values.items()))
        pieces = Window.partitionBy(*self.group).orderBy(PIECE)
        before = pieces.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            F.col(PIECE).alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(self.group)), *(KINDS[kind][0](F.col(n)).over(before).alias(f"_c_{n}") for n, (kind, _) in values.items()),
            F.lead(F.lit(True)).over(pieces).alias("_later"), F.lag(F.lit(True)).over(pieces).alias("_before"),
        ).filter("_later OR _before")
        out = derive(self.rows if rows is None else rows)
        out = out.withColumns({f"_l_{n}": KINDS[kind][0](c).over(upto) for n, (kind, c) in values.items()} | ({more: F.lead(F.lit(True)).over(inside)} if more else {}))
        same = F.col(PIECE) == F.col("_p")
        for k, g in enumerate(self.group):
            same = same & (F.col(g) == F.col(f"_g{k}"))
        out = out.join(F.broadcast(carry), same, "left")  # at most two rows a piece
        out = out.withColumns({n: KINDS[kind][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (kind, _) in values.items()} | ({more: F.coalesce(more, "_later", F.lit(False))} if more else {}))
        return out.drop("_p", "_later", "_before", *(f"_g{k}" for k in range(len(self.group))), *(f"_{x}_{n}" for n in values for x in "cl"))


#: Rows that one task may sort.
ONE_TASK = 50_000


def numbered(rows: DataFrame, order: list[Column], keep: Callable[[DataFrame], DataFrame], name: str = "rank", one_task: int = ONE_TASK) -> DataFrame:
    """Rows with their number from 1 in a total order over all of them.

    The rows are written, so that what finds them runs once. More than ``one_task`` of them are dealt by ranges of the order; the numbers are the same.
    """
    rows = keep(rows)
    if rows.count() <= one_task:  # from the files' footers
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    dealt = keep(rows.repartitionByRange(*order).withColumn(PIECE, F.spark_partition_id()))
    counts = dict(dealt.groupBy(PIECE).count().collect())  # a number a piece
    start, starts = 0, []
    for p in range(max(counts, default=-1) + 1):
        starts.append(start)
        start += counts.get(p, 0)
    local = F.row_number().over(Window.partitionBy(PIECE).orderBy(*order))
    return dealt.withColumn(name, (local + F.get(F.array(*map(F.lit, starts or [0])), F.col(PIECE))).cast("int" if start < 1 << 31 else "long")).drop(PIECE)
