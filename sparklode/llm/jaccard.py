"""Operator 8: n-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order: rare ones first, by the counts of a bounded table over the whole corpus
(:class:`Order`), ties by their hashes. Any order gives the same links; this one keeps what many documents share out of the way.

1.  *Candidates.* Two similar documents have an n-gram in common among the first few of each (the prefix that a similarity of
    ``t`` leaves). Documents meet under it only if their sizes, the places of the n-gram in both, and a parity bitmap of
    512 bits allow the similarity; these are bounds, so no link is lost.
2.  *Counts.* The order is cut into :data:`FRAGMENTS` fragments of like mass. The overlap of a candidate pair is counted in
    each fragment apart, by a join on document and fragment, and the partial overlaps are summed for each pair.
3.  *Groups.* Linked pairs make components, by a distributed label propagation over the links.

Documents with equal sets are one class from the start, and classes stand for their members. Of the classes that meet under an
n-gram, all are first compared with the one in which it comes first (copies with few changes are near that one). What this joins
needs no further pairs: then only classes that are still in different components are compared. So a group of n copies costs
about n pairs, and no link between different texts is lost: two linked classes end in one component, or are compared.

Defined results: a null, empty or blank text has an empty set and links with nothing, not even another such; with fewer words
than n, all words are the one n-gram; every row is a document of its own, so repeated rows are copies of one another, and an id with
two texts has a row for each; rows without an id take part, and a component's id is its least id (null if it has none); an empty
table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.bits import bit_table, maybe_in
from sparklode.llm.store import in_batches, Tables
from sparklode.llm.textkernel import U64, mix, shingles, slices, utf8

#: Fragments of the global order in which partial overlaps are counted.
FRAGMENTS = 8
#: Passes in which n-grams are brought together and fragments are counted, each with a share of them, so that a fourth is on disk at once.
PASSES = 4
#: Counters of n-grams, whatever the size of the corpus, and the parts in which they are summed.
COUNTERS, PARTS = 1 << 20, 64
#: Groups that the counts of all tasks are summed in, a part of the counters each, before these are summed.
LANES = 8
#: Bits of a document's parity bitmap, as longs.
LONGS = 8
#: Rows of a class that meet in one task before its members are counted are dealt to so many keys.
SALTS = 64
LEVEL_BITS = 6
LEVEL = U64(64 - LEVEL_BITS)


@dataclass
class Order:
    """The global order: a level for each counter, by the logarithm of its count, and the lower ends of the fragments."""

    level: np.ndarray
    pivots: np.ndarray

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Places of n-grams in the order, from their hashes: the level, then the hash. They stand for the n-grams from here on."""
        return self.level[(h & U64(COUNTERS - 1)).astype(np.int64)].astype(U64) << LEVEL | h >> U64(LEVEL_BITS)


def counted(docs: DataFrame, n: int, text_col: str) -> Order:
    """Counts over all texts; what reaches the driver is one number for each of :data:`COUNTERS` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for lo, hi in slices(b.column(0)):
                h, _ = shingles(*utf8(b.column(0).slice(lo, hi - lo)), n)
                total += np.bincount((h & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(PARTS, -1)], pa.binary())], ["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
        # A group is read as it comes, some rows at a time: its memory doesn't grow with the number of tasks before.
        total, part = None, 0
        for b in batches:
            part = b.column("part")[0].as_py()
            for x in b.column("counts"):
                here = np.frombuffer(x.as_py(), kind)
                total = here.astype(np.int64) if total is None else total + here
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(batches, np.uint32)

    def of_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(batches, np.int64)

    each = in_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "part int, counts binary")
    some = each.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")).applyInArrow(of_tasks, "part int, counts binary")
    sums = some.groupBy("part").applyInArrow(of_lanes, "part int, counts binary").toArrow()
    total = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for part, x in zip(sums["part"].to_pylist(), sums["counts"].to_pylist(), strict=True):
        total[part] = np.frombuffer(x, np.int64)
    total = total.reshape(-1)
    # Half octaves: chance alone doesn't set the level of an n-gram that is met in a few documents only.
    level = np.minimum(np.floor(2 * np.log2(np.maximum(total, 1))), (1 << LEVEL_BITS) - 1).astype(np.uint8)
    mass = np.concatenate(([0.0], np.cumsum(np.bincount(level, total, 1 << LEVEL_BITS))))
    goal = np.linspace(0, mass[-1], FRAGMENTS + 1)[:-1]
    k = np.minimum(np.searchsorted(mass, goal, side="right") - 1, (1 << LEVEL_BITS) - 1)
    share = (goal - mass[k]) / np.maximum(mass[k + 1] - mass[k], 1)
    pivots = (k.astype(U64) << LEVEL) + (share * float(1 << 57)).astype(U64) * U64(2)
    return Order(level, pivots)


def _by_text(column: pa.Array, n: int, order: Order) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text by their places in the order, a bounded number of texts at a time."""
    for lo, hi in slices(column):
        h, off = shingles(*utf8(column.slice(lo, hi - lo)), n)
        k = order.keys(h)
        for i in range(len(off) - 1):
            x = np.sort(k[off[i] : off[i + 1]])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def parity(x: np.ndarray) -> np.ndarray:
    """Bitmap in which each member of the set flips one bit: two bitmaps differ in no more bits than the sets in members."""
    odd = np.bincount((mix(x) >> U64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(n: int, t: Fraction) -> int:
    """As many first n-grams of a set hold one that a similar set has as well: it shares t * n of them at least."""
    return n - -(-n * t.numerator // t.denominator) + 1


def fingerprints(docs: DataFrame, n: int, t: Fraction, order: Order, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bits, first): the set's size, a 128-bit hash of it, its bitmap, and its first n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(order)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, a, c, bits, first = [], [], [], [], []
            for x in _by_text(b.column(1), n, held.value):
                size.append(len(x))
                with np.errstate(over="ignore"):
                    a.append(mix(x).sum(dtype=U64))
                    c.append(mix(x ^ U64(0x5DEECE66D1CE4E5B)).sum(dtype=U64))
                bits.append(parity(x))
                first.append(x[: prefix(len(x), t)] if len(x) else x)
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in xs)])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(np.array(a, U64).view(np.int64)), pa.array(np.array(c, U64).view(np.int64)), lists(bits), lists(first)],
                ["doc_id", "n_shingles", "set_a", "set_b", "bits", "first"],
            )

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, first array<long>")


def fragments(docs: DataFrame, wanted: DataFrame, n: int, order: Order, id_col: str, text_col: str) -> DataFrame:
    """(rep, fragment, grams) of the wanted classes (rep, doc_id, set_a): the n-grams of a set in each fragment where it has any."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0), []
            for i, x in enumerate(_by_text(b.column(1), n, held.value)):
                cut = np.append(np.searchsorted(x, held.value.pivots), len(x))
                with np.errstate(over="ignore"):
                    a = int(mix(x).sum(dtype=U64).view(np.int64))
                out += [(i, a, g, x[cut[g] : cut[g + 1]].view(np.int64)) for g in range(FRAGMENTS) if cut[g + 1] > cut[g]]
                if len(out) > 8192:
                    yield packed(ids, out)
                    out = []
            yield packed(ids, out)

    def packed(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        off = np.concatenate(([0], np.cumsum([len(o[3]) for o in out]))).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int64), *(o[3] for o in out)])))
        return pa.RecordBatch.from_arrays([ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()), grams], ["doc_id", "set_a", "fragment", "grams"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = maybe_in(texts, "doc_id", bit_table(wanted.select("doc_id"))).mapInArrow(run, "doc_id long, set_a long, fragment int, grams array<long>")
    sides = rows.withColumnRenamed("doc_id", "_d").withColumnRenamed("set_a", "_a")
    return wanted.join(sides, wanted["doc_id"].eqNullSafe(sides["_d"]) & (wanted["set_a"] == sides["_a"])).select("rep", "fragment", "grams")


def enough(overlap: Column, together: Column, t: Fraction) -> Column:
    """Whether sets with so many members together and in common are similar."""
    return overlap * (t.denominator + t.numerator) >= together * t.numerator


def may_link(na: Column, nb: Column, pa_: Column, pb: Column, t: Fraction) -> Column:
    """For the first n-gram in common, at places pa and pb: whether the members from there on can be enough."""
    return enough(F.least(na - pa_, nb - pb), na + nb, t)


def bits_allow(a: str, b: str, together: Column, t: Fraction) -> Column:
    """Whether the bitmaps differ in no more bits than similar sets can in members."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, LONGS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return differ * (t.denominator + t.numerator) <= together * (t.denominator - t.numerator)


def linked(pairs: DataFrame, parts: DataFrame, lead: DataFrame, t: Fraction, tables: Tables) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps counted in each fragment apart, a few fragments a pass, then summed for each pair."""
    counts = []
    for k in range(PASSES):
        few = parts.filter((F.col("fragment") >= k * FRAGMENTS // PASSES) & (F.col("fragment") < (k + 1) * FRAGMENTS // PASSES))
        one = few.select(F.col("rep").alias("a"), "fragment", F.col("grams").alias("ga"))
        two = few.select(F.col("rep").alias("b"), "fragment", F.col("grams").alias("gb"))
        each = pairs.select("a", "b").join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
        counts.append(tables.keep(each.groupBy("a", "b", "fragment").agg(F.max("o").alias("o")), "jaccard-counts"))  # a class' text may be there twice
    total = reduce(DataFrame.unionByName, counts).groupBy("a", "b").agg(F.sum("o").alias("o"))
    size = lambda v: lead.select(F.col("rep").alias(v), F.col("n").alias(f"n{v}"))
    return total.join(size("a"), "a").join(size("b"), "b").filter(enough(F.col("o"), F.col("na") + F.col("nb"), t)).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, c): the smallest node reachable from each node. Alternating large-star and small-star steps, each a table in the shared folder."""
    tables = Tables(nodes.sparkSession)
    star = tables.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "cc")
    seen = None
    while True:
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour is joined to the least of the neighbourhood.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # Small star: every smaller neighbour, and the node itself, likewise.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        before, star = star, tables.keep(small, "cc")
        tables.drop(before)
        state = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    label = star.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    found = Tables(nodes.sparkSession).keep(nodes.join(label, nodes["v"] == F.col("_u"), "left").select("v", F.coalesce("m", "v").alias("c")), "cc")
    tables.drop_all()
    return found


def classes(prints: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, rep): the least row with the same set for each row with a set; rows of a large class are dealt to many keys first."""
    key = ["n_shingles", "set_a", "set_b"]
    rows = prints.filter("n_shingles > 0").select("row", "doc_id", *key, F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    some = rows.groupBy(*key, "salt").agg(F.min("row").alias("least"))
    rep = some.groupBy(*key).agg(F.min("least").alias("rep"))
    return rows.join(some.join(rep, key).drop("least"), [*key, "salt"]).select("row", "doc_id", "n_shingles", "rep")


def grouped(docs: DataFrame, n: int = 3, similarity: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, leads): one row a row; rows of one class have equal sets; one row of each component leads it."""
    t, tables = Fraction(similarity), Tables(docs.sparkSession)
    order = counted(docs, n, text_col)
    prints = tables.keep(fingerprints(docs, n, t, order, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "jaccard-prints")
    member = tables.keep(classes(prints), "jaccard-class")
    same = member.filter("row = rep").select("rep")
    leaders = prints.join(same, prints["row"] == same["rep"]).withColumnRenamed("n_shingles", "n")
    lead = tables.keep(leaders.select("rep", "doc_id", "set_a", "n", "bits"), "jaccard-lead")
    start = tables.keep(leaders.select("rep", "n", "first"), "jaccard-first")
    empty = prints.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("class_id"), F.lit(True).alias("leads"))
    empty = tables.keep(empty, "jaccard-empty")
    tables.drop(prints)

    # Classes that meet under an n-gram, and the one of them in which it comes first.
    sig, met = start.select("rep", "n", F.posexplode("first").alias("pos", "gram")), []
    for k in range(PASSES):
        few = sig.filter(F.pmod("gram", F.lit(PASSES)) == k)
        met.append(tables.keep(few.join(few.groupBy("gram").agg(F.count("*").alias("met")).filter("met > 1").select("gram"), "gram"), "jaccard-met"))
    tables.drop(start)
    shared, met = met, reduce(DataFrame.unionByName, met)
    heads = met.groupBy("gram").agg(F.min(F.struct("pos", "rep", "n")).alias("head"))
    bucket = tables.keep(met.join(heads, "gram"), "jaccard-buckets")
    tables.drop(*shared)
    star = bucket.filter((F.col("rep") != F.col("head.rep")) & may_link(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos"), t))
    star = star.select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()

    def close(p: DataFrame) -> DataFrame:
        """The pairs whose bitmaps allow the similarity."""
        side = lambda v: lead.select(F.col("rep").alias(v), F.col("n").alias(f"n{v}"), F.col("bits").alias(f"bits_{v}"))
        return p.join(side("a"), "a").join(side("b"), "b").filter(bits_allow("bits_a", "bits_b", F.col("na") + F.col("nb"), t)).select("a", "b")

    def compared(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return tables.keep(pairs.select("a", "b"), "jaccard-links")
        wanted = lead.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep").select("rep", "doc_id", "set_a")
        parts = tables.keep(fragments(docs, wanted, n, order, id_col, text_col), "jaccard-fragments")
        links = tables.keep(linked(pairs, parts, lead, t, tables), "jaccard-links")
        tables.drop(parts)
        return links

    first = tables.keep(close(star), "jaccard-first")
    links = compared(first)
    group = components(lead.select(F.col("rep").alias("v")), links).withColumnRenamed("v", "rep")

    # Classes that meet and are in different components still.
    held = bucket.select("gram", "pos", "rep", "n").join(group, "rep")
    split = held.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("gram")
    rest = tables.keep(held.join(split, "gram").join(lead.select("rep", "bits"), "rep"), "jaccard-rest")
    side = lambda v: rest.select("gram", *(F.col(x).alias(f"{x}_{v}") for x in ("rep", "pos", "n", "c", "bits")))
    meet = (F.col("c_a") < F.col("c_b")) & may_link(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b"), t) & bits_allow("bits_a", "bits_b", F.col("n_a") + F.col("n_b"), t)
    across = side("a").join(side("b"), "gram").filter(meet).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    across = tables.keep(across.join(first, ["a", "b"], "left_anti"), "jaccard-across")
    tables.drop(bucket, rest)
    more = compared(across)
    of = lambda v: group.select(F.col("rep").alias(v), F.col("c").alias(f"c{v}"))
    joins = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    final = components(group.select(F.col("c").alias("v")).distinct(), joins)
    comp = group.join(final.select(F.col("v").alias("c"), F.col("c").alias("k")), "c").select("rep", "k")

    # A component's id is the least id of its members; the first row with that id leads it.
    low = lambda c: F.min(c).alias("least")
    of_class = member.groupBy("rep").agg(low(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")))
    of_group = of_class.join(comp, "rep").groupBy("k").agg(low("least"))
    of_class = comp.join(of_group, "k").select("rep", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("leader"))
    found = member.join(of_class, "rep").select("doc_id", "n_shingles", "component_id", F.col("rep").alias("class_id"), (F.col("row") == F.col("leader")).alias("leads"))
    out = Tables(docs.sparkSession).keep(found.unionByName(empty), "jaccard-groups")
    tables.drop_all()
    return out


def deduplicated(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of a component; rows without an id stay, and repeated rows of an id that stays.

    Only rows whose id may have to go are exchanged.
    """
    gone = grouped(docs, n, similarity, id_col, text_col).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_stays")).filter("NOT _stays").select("_gone")
    gone = Tables(docs.sparkSession).keep(gone, "jaccard-gone")
    number = "_number"
    while number in docs.columns:
        number += "_"
    rows, table = docs.withColumn(number, F.col(id_col).cast("long")), bit_table(gone)
    maybe, sure = (maybe_in(rows, number, table, inside) for inside in (True, False))
    return sure.unionByName(maybe.join(gone, maybe[number] == gone["_gone"], "left_anti")).select(docs.columns)
