"""Conversation prefix trie: what conversations share from their first turn on, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and its smallest member owns it. As
the members of a deeper node are members of those above, a conversation owns a suffix of its path. So one number a conversation, the
depth where its own part begins, says which nodes are its own: a window over the members of each node marks them. Everything below a
node is then a sum over its members: the bytes of all their occurrences below it less the bytes of the nodes they own there, and a flag
for each member that owns a leaf. One group-by over prefixes adds these up.

Turns are carried as digests (120 bits of MD5 of role and text) and sizes: texts aren't shuffled. A prefix is the exclusive-or of the
128-bit hashes of its turns with their places, a running value. Conversations of any length, and prefixes with any number of members,
are dealt over several tasks (:mod:`sparklode.operators.ranks`).

Defined results. Rows with a null conv_id take no part. Turns are ordered by turn, null first, then by their digests; repeated rows are
turns of their own. A null role or text is empty. A conversation whose rebuilt form has no turns is a member of the root. No rows, no
root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklode.llm.store import Tables, in_batches
from sparklode.operators.ranks import PIECE, Pieces

#: Rebuilding: conversations of one number of FAMILY share up to SHARED - 1 first turns.
FAMILY, SHARED = 5, 9
#: Ids joined to one text before they are hashed.
BLOCK = 1024
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, d1, d2, n_bytes) of each row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), half(1).alias("d1"), half(16).alias("d2"), F.octet_length(text).cast("long").alias("n_bytes"))


def placed(rows: DataFrame, tables: Tables) -> DataFrame:
    """:func:`turns` with ``i``, their place in the conversation from 1."""
    order = Pieces(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")], lambda d: tables.keep(d, "trie-turns"))
    out = tables.keep(order.running({"i": ("sum", F.lit(1).cast("long"))}).select("conv_id", "i", "d1", "d2", "n_bytes"), "trie-placed")
    tables.drop(order.rows)
    return out


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, section, i, d1, d2, n_bytes): a root row (section 0), the turns of the family's first (1), and the conversation's own (2)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    every = own.filter("i = 1").select("conv_id")
    root = every.select("conv_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("i"), *(F.lit(0).cast("long").alias(c) for c in ("d1", "d2", "n_bytes")))
    head = own.filter(F.col("i") < SHARED).withColumnRenamed("conv_id", "_first")
    first = every.select("conv_id", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_first"))
    shared = first.join(head, "_first").filter("i <= _h").select("conv_id", F.lit(1).alias("section"), "i", "d1", "d2", "n_bytes")
    return root.unionByName(shared).unionByName(own.filter(F.col("i") > h).select("conv_id", F.lit(2).alias("section"), "i", "d1", "d2", "n_bytes"))


def occurrences(rows: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, depth, k1, k2, n_bytes, upto, goes_on): the prefixes of each conversation, with the bytes of their last turn and of all."""
    line = Pieces(rows, ["conv_id"], [F.col("section"), F.col("i")], lambda d: tables.keep(d, "trie-line"))

    def hashed(part: DataFrame) -> DataFrame:
        deep = line.running({"_n": ("sum", F.lit(1).cast("long"))}, rows=part).withColumn("depth", F.col("_n") - 1)
        mark = lambda k: F.when(F.col("section") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "d1", "d2"))
        return deep.withColumns({"_e1": mark(1), "_e2": mark(2)})

    found = line.running({"k1": ("xor", F.col("_e1")), "k2": ("xor", F.col("_e2")), "upto": ("sum", F.col("n_bytes"))}, derive=hashed, more="goes_on")
    return found.select("conv_id", "depth", "k1", "k2", "n_bytes", "upto", "goes_on")


def owners(rows: DataFrame, tables: Tables) -> DataFrame:
    """:func:`occurrences` with ``owner``, the smallest member of each prefix, and the piece of the order by prefix."""
    order = Pieces(rows, ["k1", "k2"], [F.col("conv_id")], lambda d: tables.keep(d, "trie-prefixes"))
    out = tables.keep(order.running({"owner": ("min", F.col("conv_id"))}).drop("_tie"), "trie-owned")
    tables.drop(order.rows)
    return out


def ends(owned: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of prefixes where a conversation ends: its ids, ascending and comma-joined, hashed as they come."""
    last = owned.filter("NOT goes_on")
    block = F.floor((F.row_number().over(Window.partitionBy(PIECE, "k1", "k2").orderBy("conv_id")) - 1) / BLOCK)
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = last.withColumn("_b", block).groupBy(PIECE, "k1", "k2", "_b").agg(F.min("conv_id").alias("_low"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mark = None, None
        for batch in batches:
            done = []
            for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k1, k2) != at:
                    if at is not None:
                        done.append((*at, mark.hexdigest()))
                    at, mark = (k1, k2), hashlib.sha256(text.encode())
                else:
                    mark.update(b"," + text.encode())
            yield _batch(done)
        if at is not None:
            yield _batch([(*at, mark.hexdigest())])

    dealt = in_batches(blocks).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "_low")
    return dealt.select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), r, strict=True)) for r in rows], pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))


def nodes(owned: DataFrame) -> DataFrame:
    """One row a node, by its prefix."""
    mine = F.col("owner") == F.col("conv_id")
    # Where a conversation's own part begins, who owns the node above it, and the bytes up to there. Owned nodes are a suffix of the path.
    own = owned.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("begins"), F.max_by(F.when(~mine, F.col("owner")), F.when(~mine, F.col("depth"))).alias("above"), F.max(F.when(~mine, F.col("upto"))).alias("shared")
    )
    leaves = owned.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.max("goes_on").alias("_on")).filter("NOT _on").select("conv_id", F.lit(1).alias("leaf"))
    rows = owned.join(own.join(leaves, "conv_id", "left"), "conv_id")  # a long conversation's rows may be split by Spark (skewed join)
    parent = F.when(mine & (F.col("depth") > 0), F.when(F.col("depth") > F.col("begins"), F.col("conv_id")).otherwise(F.col("above")))
    saved = F.when(mine, F.lit(0)).otherwise(F.col("shared") - F.col("upto") + F.col("n_bytes"))
    child = F.col("goes_on") & F.coalesce(F.col("depth") + 1 >= F.col("begins"), F.lit(False))
    return rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if(child).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations."""
    tables = Tables(conversations.sparkSession)
    own = placed(turns(conversations), tables)
    owned = owners(occurrences(rebuilt(own), tables), tables)
    found = nodes(owned).join(ends(owned), ["k1", "k2"], "left").drop("k1", "k2")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
