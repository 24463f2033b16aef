"""Vector code compression: product codes over integer vectors, nearest entries found by annular norm pruning.

Codebooks are trained by whole-number k-means over all rows: a round assigns each part to its nearest entry in numpy batches, a task
gives one row of sums an entry, and Spark adds these up. The driver holds the codebooks only (entries x dimension numbers).

An entry's distance to a part is at least the difference of their norms. So entries lie sorted by norm; a batch of parts of like norm
starts with the entries around its own norm, and what may still be nearer lies in an interval of norms (an annulus) that a binary
search finds from the best distance so far. Entries of the interval, ends included, are evaluated exactly, outward in blocks, while
each part's interval shrinks.

Defined results. Rows whose vector is null or holds a null or non-finite component are dropped; so are vectors of another length than
that of the smallest vec_id kept (no distance to them is defined). A length that four doesn't divide is filled up with zeros. Fewer
than 256 rows make smaller codebooks, none make none. Repeated rows count each; a repeated vec_id orders by its vector. Sums that no
long can hold (components over 2**14) are worked out in Python's integers and end at the largest long. Other columns are
carried by :func:`encoded`, whatever their names; those it adds come last and replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import Tables, in_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are looked at together, and entries evaluated at once.
CHUNK, BLOCK = 512, 32
#: Totals by label are broadcast up to this many labels.
FEW = 10_000
LARGEST = (1 << 63) - 1


def kept(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole, finite vector."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return table.filter(F.col(vector).isNotNull() & ~F.exists(vector, odd))


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as int64 where every later sum is sure to fit, else as Python's integers."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if scaled.size == 0 or np.abs(scaled).max() < 1 << 24:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


class Codebook:
    """One part's entries, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares.astype(np.float64), kind="stable")
        self.sorted, self.squares = entries[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part; of equal ones the smallest index. Exact."""
        n = len(parts)
        index, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=parts.dtype)
        if n == 0 or parts.shape[1] == 0:
            return index, best
        squares = (parts * parts).sum(axis=1)
        norms = np.sqrt(squares.astype(np.float64))
        order = np.argsort(norms, kind="stable")
        exact = parts.dtype != object and self.sorted.dtype != object
        floats = exact and 4 * parts.shape[1] * float(max(np.abs(parts).max(), np.abs(self.sorted).max(), 1)) ** 2 < 2.0**53
        rows, entries = (parts.astype(np.float64), self.sorted.astype(np.float64)) if floats else (parts, self.sorted)
        for at in range(0, n, CHUNK):
            pick = order[at : at + CHUNK]
            index[pick], best[pick] = self._chunk(rows[pick], squares[pick], norms[pick], entries)
        return index, best

    def _chunk(self, rows: np.ndarray, squares: np.ndarray, norms: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = len(entries)
        middle = int(np.searchsorted(self.norms, norms[len(norms) // 2]))
        low, high = max(0, min(middle - BLOCK // 2, total - BLOCK)), min(total, max(middle + BLOCK // 2, BLOCK))
        best, index = self._evaluated(rows, squares, entries, low, high)
        while low > 0 or high < total:
            # The annulus of each part by its best distance so far; a little wider than that, as norms are rounded.
            reach = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (norms + reach) + 1e-9
            first = np.searchsorted(self.norms, norms - reach - slack, "left")
            last = np.searchsorted(self.norms, norms + reach + slack, "right")
            below, above = np.flatnonzero(first < low), np.flatnonzero(last > high)
            if len(below) == 0 and len(above) == 0:
                break
            for part, a, b in ((below, max(0, low - BLOCK), low), (above, high, min(total, high + BLOCK))):
                if len(part) and a < b:
                    d, i = self._evaluated(rows[part], squares[part], entries, a, b)
                    nearer = (d < best[part]) | (d == best[part]) & (i < index[part])
                    best[part[nearer]], index[part[nearer]] = d[nearer], i[nearer]
            low, high = max(0, low - BLOCK) if len(below) else low, min(total, high + BLOCK) if len(above) else high
            if not len(below):  # no part needs what lies further down, and intervals only shrink
                low = 0
            if not len(above):
                high = total
        return index, best

    def _evaluated(self, rows: np.ndarray, squares: np.ndarray, entries: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        inner = rows @ entries[a:b].T
        if inner.dtype == np.float64:
            inner = inner.astype(np.int64)
        distance = squares[:, None] + self.squares[None, a:b] - 2 * inner
        least = distance.min(axis=1)
        return least, np.where(distance == least[:, None], self.order[None, a:b], len(entries)).min(axis=1)


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) whole numbers of a batch's vectors."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, PARTS * width))
    full = np.zeros((n, PARTS * width), dtype=np.float64)
    full[:, : flat.shape[1]] = flat
    return whole_numbers(full).reshape(n, PARTS, width)


def first_entries(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> list[np.ndarray]:
    """The parts of the 256 smallest ids as codebooks; a list of (entries, width), empty without rows. ``rows`` have one length."""
    head = rows.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(ENTRIES).collect()
    if not head:
        return []
    width = -(-len(head[0][1]) // PARTS)
    flat = np.zeros((len(head), PARTS * width))
    for k, row in enumerate(head):
        flat[k, : len(row[1])] = row[1]
    numbers = whole_numbers(flat).reshape(len(head), PARTS, width)
    return [numbers[:, p] for p in range(PARTS)]


def next_entries(rows: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and each entry becomes the floor of its parts' mean."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            parts = _parts(batch.column(0), width)
            for p in range(PARTS):
                index, _ = search[p].nearest(parts[:, p])
                order = np.argsort(index, kind="stable")
                used, start, n = np.unique(index[order], return_index=True, return_counts=True)
                if len(used):
                    total[p][used] += np.add.reduceat(parts[order, p], start, axis=0).astype(object)
                    count[p][used] += n
        for p in range(PARTS):
            used = np.flatnonzero(count[p])
            # In two halves of 40 bits, so that sums of longs stay exact in Spark.
            high, low = total[p][used] >> 40, total[p][used] & ((1 << 40) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used], pa.int64()), pa.array(high.tolist(), pa.list_(pa.int64())), pa.array(low.tolist(), pa.list_(pa.int64()))],
                ["part", "entry", "n", "high", "low"],
            )

    partial = in_batches(rows.select(vector)).mapInArrow(sums, "part int, entry int, n long, high array<long>, low array<long>")
    added = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("high")[i]) for i in range(width))).alias("high"), F.array(*(F.sum(F.col("low")[i]) for i in range(width))).alias("low")
    )
    out = [b.astype(object) for b in books]
    for r in added.collect():  # at most an entry of a codebook each
        for i in range(width):
            out[r["part"]][r["entry"], i] = ((r["high"][i] << 40) + r["low"][i]) // r["n"]
    return [o.astype(np.int64) if o.size == 0 or max(map(abs, o.ravel().tolist())) < 1 << 24 else o for o in out]


def trained(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds over all ``rows`` (of one length)."""
    books = first_entries(rows, vec_id, vector)
    for _ in range(rounds if books and books[0].shape[1] else 0):
        books = next_entries(rows, books, vector)
    return books


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, comma-joined by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def of_one_length(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """:func:`kept` rows whose vectors are as long as that of the smallest id."""
    rows = kept(table, vector)
    first = rows.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(1).collect()
    return rows.filter(F.size(vector) == (len(first[0][1]) if first else 0))


def encoded(rows: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """``rows`` (of one length) with ``code`` (two hex digits a part) and ``error`` (squared distances, summed over the parts)."""
    width = books[0].shape[1] if books else 0
    carried = [c for c in rows.columns if c not in ("code", "error")]
    names = [f"c{k}" for k in range(len(carried))]
    out = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, carried, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            parts = _parts(batch.column(batch.num_columns - 1), width)
            found = [search[p].nearest(parts[:, p]) for p in range(PARTS)] if books else []
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
            error = [min(sum(row), LARGEST) for row in zip(*(f[1].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*names, "code", "error"])

    wide = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)), F.col(vector).alias("_vector"))
    coded = in_batches(wide).mapInArrow(run, f"{out}, code string, error long")
    return coded.select(*(F.col(n).alias(c) for n, c in zip(names, carried, strict=True)), "code", "error")


def compressed(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row kept."""
    rows = of_one_length(table, vec_id, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    books = trained(rows)
    tables = Tables(table.sparkSession)
    codes = tables.keep(encoded(rows, books).select("vec_id", "label", "code", "error"), "vector-codes")
    # Decimals hold any sum; what is beyond a long ends at the largest.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    totals = tables.keep(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "vector-labels")
    few = totals.count() <= FEW
    # With many labels Spark splits a frequent one itself (skewed joins), as the rows' side may be split in an outer join.
    joined = codes.join(F.broadcast(totals) if few else totals.hint("merge"), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
