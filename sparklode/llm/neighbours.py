"""Operator 4: approximate nearest neighbours by adaptive dimension scan.

Index: vectors are turned by a random rotation and dealt to lists by a k-means coarse quantizer, fitted on a bounded sample
(:data:`SAMPLE` rows of smallest id hash); every row is indexed. Long lists are cut into blocks by a hash of the id, so that no task
needs a whole list.

Search: a query probes the lists with the best centroids; the first of them gives a floor, the score of its twentieth best there,
with which it goes through the others. In a block its candidates are scanned in blocks of columns of the rotated
vectors. After each block of columns the inner product so far bounds what the rest can add: on rotated vectors the rest's share
of both norms is known, and the angle between the rests is like a random one, so a test at :data:`SIGMAS` standard deviations
abandons candidates that can't reach the floor. What is left is computed in double precision on the original
vectors, and ranked; ties go to the smaller id.

Defined results: vectors that are null or zero, or hold null or non-finite components, or whose length isn't the most common one, take no
part; with fewer candidates than ``top`` all are returned; equal vectors are all candidates; the rows of an id are one candidate, with
the best of their scores, and one query, of their least vector; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklode.llm.store import in_batches, materialize

SAMPLE = 20_000
TOP = 20
#: Rows of a list in one block, which a task holds, and queries that go by it in one task.
BLOCK, QUERIES = 4096, 1 << 20
SIGMAS = 4.0
STEPS = 4
#: Share of the lists that a query probes, and the fewest.
PROBE_SHARE, PROBE_LEAST = 0.72, 8
#: Rows of a list, as long as there are at most 4096 lists.
LIST = 1024


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    width: int


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0))
    )


def fitted(rows: DataFrame, seed: int = 3, rounds: int = 12) -> Index | None:
    """Rotation and centroids from a bounded sample; the number of lists grows with the table, up to a bound."""
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return None
    width, total = widths[0]["w"], widths[0]["count"]
    few = rows.filter(F.size("v") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    x = few.values.to_numpy(zero_copy_only=False).reshape(-1, width)
    r = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(r.normal(size=(width, width)))
    x = x @ rotation
    lists = int(min(max(1, -(-total // LIST), min(16, total // 64)), 4096, max(1, len(x) // 4)))
    c = x[r.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[k : k + 4096] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) for k in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return Index(rotation, c, min(lists, max(PROBE_LEAST, math.ceil(PROBE_SHARE * lists))), width)


def scan(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each rotated query (row of q): positions of the candidates of a block that the tests leave."""
    width = q.shape[1]
    cuts = np.linspace(0, width, STEPS + 1).astype(int)
    x2 = np.zeros((len(x), STEPS + 1))
    for s in range(STEPS):
        x2[:, s + 1] = x2[:, s] + (x[:, cuts[s] : cuts[s + 1]] ** 2).sum(axis=1)
    reach = SIGMAS * np.sqrt(np.maximum(x2[:, -1:] - x2, 0)) / np.sqrt(np.maximum(width - cuts, 1))
    parts = [np.ascontiguousarray(x[:, cuts[s] : cuts[s + 1]]) for s in range(STEPS)]
    # The first columns of all queries at once: nothing can be abandoned before them.
    first = q[:, : cuts[1]] @ parts[0].T
    left = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - np.cumsum(np.add.reduceat(q**2, cuts[:-1], axis=1), axis=1), 0))
    for i in range(len(q)):
        low = floor[i] - 1e-9 * abs(floor[i]) if np.isfinite(floor[i]) else -np.inf
        alive = np.flatnonzero((first[i] + left[i, 0] * reach[:, 1] >= low) & (ids != own[i]))
        dot = first[i, alive]
        for s in range(1, STEPS):
            dot = dot + parts[s][alive] @ q[i, cuts[s] : cuts[s + 1]]
            keep = dot + left[i, s] * reach[alive, s + 1] >= low
            alive, dot = alive[keep], dot[keep]
        if len(alive) > top:
            least = np.partition(dot, len(dot) - top)[len(dot) - top]
            alive = alive[dot >= least - 1e-9 * (1 + abs(least))]
        yield i, alive


def _block(rows: list[tuple[np.ndarray, np.ndarray]], ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, vectors, rotated vectors, most different vectors of an id); equal rows of an id are one."""
    ids, v = (np.concatenate(x) for x in zip(*rows, strict=True))
    _, again, n = np.unique(ids, return_inverse=True, return_counts=True)
    if (several := np.flatnonzero(n[again] > 1)).size:
        _, first = np.unique(np.column_stack([ids[several].astype(np.int64).view(np.float64), v[several]]).view(np.dtype((np.void, 8 * (ix.width + 1)))), return_index=True)
        keep = np.sort(np.concatenate([np.flatnonzero(n[again] == 1), several[first]]))
        ids, v = ids[keep], v[keep]
        n = np.unique(ids, return_counts=True)[1]
    return ids, v, v @ ix.rotation, int(n.max())


def _nearest(block: tuple[np.ndarray, np.ndarray, np.ndarray, int], own: np.ndarray, q: np.ndarray, floor: np.ndarray, top: int, ix: Index) -> pa.RecordBatch:
    """The nearest of a block for each query, as rows (query_id, vec_id, score)."""
    ids, x, turned, most = block
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # Different rows of an id are one candidate, so they mustn't take the places of others.
    for i, at in scan(q @ ix.rotation, turned, ids, own, floor, top * most):
        exact = (x[at] * q[i]).sum(axis=1)
        order = np.lexsort((ids[at], -exact))
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:top]]
        out.append((np.full(len(order), own[i]), ids[at][order], exact[order]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def searched(vectors: DataFrame, queries: DataFrame | None = None, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each query, nearest first. ``queries`` has the same columns."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col) if queries is not None else rows.filter("vec_id % 20 = 0")
    index = fitted(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(index)  # at most 4096 centroids and a square matrix

    def deal(batches: Iterator[pa.RecordBatch], probes: bool) -> Iterator[pa.RecordBatch]:
        ix = held.value
        half = 0.5 * (ix.centroids**2).sum(axis=1)
        for b in batches:
            ids = b.column(0).to_numpy()
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, ix.width)
            score = (v @ ix.rotation) @ ix.centroids.T - half
            lists = np.argsort(-score, axis=1, kind="stable")[:, : ix.probes] if probes else score.argmax(axis=1)[:, None]
            k = lists.shape[1]
            order = np.tile(np.arange(k, dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(lists.reshape(-1).astype(np.int32)), pa.array(order)], ["vec_id", "list", "nth"])

    fit = F.size("v") == index.width
    rows, asked = rows.filter(fit), asked.filter(fit)
    where = materialize(rows.mapInArrow(lambda it: deal(it, False), "vec_id long, list int, nth int").select("vec_id", "list").groupBy("vec_id").agg(F.min("list").alias("list")), "ann-lists")
    blocks = F.broadcast(where.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")))  # one row a list
    filed = rows.join(where, "vec_id").join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    once = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = materialize(once.mapInArrow(lambda it: deal(it, True), "vec_id long, list int, nth int"), "ann-probed")
    # The queries of a list are dealt as well: a task meets a block of a list with a block of the queries that probe it.
    turns = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("turns")))  # one row a list
    probe = probes.join(turns, "list").withColumn("turn", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("turns")).cast("int")).join(blocks, "list")
    probe = probe.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("vec_id", "list", "nth", "block", "turn").join(once, "vec_id")
    filed = filed.join(turns, "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    filed, probe = materialize(filed.select("vec_id", "list", "block", "turn", "v"), "ann-index"), materialize(probe, "ann-probes")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (list, block, turn), the candidates of each before its queries: a block is held, the queries go by."""
        ix, key, held_rows, block = held.value, None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            ids, v = b.column(4).to_numpy(), b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, ix.width)
            floor = b.column(6).to_numpy(zero_copy_only=False)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(keys[lo, :3]) != key:
                    key, held_rows, block = tuple(keys[lo, :3]), [], None
                if keys[lo, 3] == 0:
                    held_rows.append((ids[lo:hi], v[lo:hi]))
                elif held_rows:
                    block = block or _block(held_rows, ix)
                    yield _nearest(block, ids[lo:hi], v[lo:hi], floor[lo:hi], top, ix)

    def through(some: DataFrame) -> DataFrame:
        place = ["list", "block", "turn"]
        left = filed.select(*place, F.lit(0).alias("tag"), "vec_id", "v", F.lit(0.0).alias("floor"))
        rows = left.unionByName(some.select(*place, F.lit(1).alias("tag"), "vec_id", "v", "floor"))
        rows = in_batches(rows).repartition(*place).sortWithinPartitions(*place, "tag")
        return rows.mapInArrow(find, "query_id long, vec_id long, score double")

    first = materialize(through(probe.filter("nth = 0").withColumn("floor", F.lit(float("-inf")))), "ann-first")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = first.withColumn("k", best).filter(F.col("k") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = probe.filter("nth > 0").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.unionByName(through(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
