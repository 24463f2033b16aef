"""Operator 5: mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target over its size is the number of copies each of its documents is due: whole copies are certain. Of what is left of
the target, ``left`` words, a document has the inclusion probability ``p = left * w / sum(w * size)``, where its weight w is its
size up to :data:`FULL` words, and :data:`SOME`: scraps are repeated less often than articles. Documents are ranked by their random odds over their inclusion
odds, ``(u / (1 - u)) / (p / (1 - p))``, and the first are taken until their words are as near ``left`` as whole documents allow: the
sample has a fixed size in words, within half of the document at the cut, which bounds its standard deviation; u and p settle which ones.

The random number of a document is a hash of the seed and its id, so reruns agree. The place of the cut is found in two levels: sums of
bins of the rank, then the order in the one bin of each source in which the cut falls. All other documents are told by their
bin alone; no task sorts a source, and :func:`mixed` moves no text.

Defined results: null or empty texts have size 0 and are never short of their target; a null source is one source of its own, last
in order; equal rows (id, source and size) count each, and are taken alike; a source without words takes none; an empty table
gives an empty one; other columns are carried by :func:`mixed` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklode.llm.quality_rules import WORD_GAP
from sparklode.llm.store import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: What every document weighs, the words from which documents weigh the same, and the most an inclusion probability can be.
SOME, FULL, NEAR_ONE = 100, 1000, 0.999
#: Bins of the rank for each source: so many at least, and so many rows in one on average at most.
BINS, BIN_ROWS = 256, 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) with 52 random bits, from the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes by weight, stopped at ``most`` times the source's size, the excess reshared.

    The stopped sources are those with the least room for their weight, so one ordered pass over the sources finds them. The
    windows without partitions hold one row a source, never documents.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    line = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = (
        s.withColumn("_all", F.sum("source_size").over(everything) * share)
        .withColumn("_allw", F.sum("_w").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_wbefore", F.coalesce(F.sum("_w").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # What a unit of weight gets, were this source and all after it not stopped.
        .withColumn("_unit", (F.col("_all") - F.col("_before")) / (F.col("_allw") - F.col("_wbefore")))
        .withColumn("_open", F.col("_cap") > F.col("_unit") * F.col("_w"))
        .withColumn("_first", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_unit").alias("u")))).over(everything)["u"])
    )
    return s.select("source", "source_size", F.when(F.col("_open"), F.col("_first") * F.col("_w")).otherwise(F.col("_cap")).cast("double").alias("target"))


def placed(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, ...) with their source's goal, the certain copies, the rank by odds, and its bin."""
    rows = rows.withColumn("_s", _key(rows["source"])).join(goal.drop("source"), "_s")
    w = SOME + F.least(F.col("size"), F.lit(FULL))
    p = F.least(F.try_divide(F.col("_left") * w, F.col("_mass")), F.lit(NEAR_ONE))
    odds = F.try_divide(F.col("_u") / (1 - F.col("_u")), F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_p", F.when((F.col("_left") > 0) & (F.col("size") > 0), p)).withColumn("_odds", F.when(F.col("_p") > 0, odds))
    # Against the odds of the source as a whole ranks are spread like u.
    part = F.least(F.try_divide("_left", "source_size"), F.lit(NEAR_ONE))
    even = F.col("_odds") * (part / (1 - part))
    return rows.withColumn("_bin", F.floor(even / (1 + even) * F.col("_bins")).cast("long"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _place() -> Column:
    return F.struct("_odds", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("_u", uniform("doc_id", seed))


def cuts(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_s, source_size, target, ...) of each source, with the bin of the cut and the last place taken in it: one row a source."""
    w = SOME + F.least(F.col("size"), F.lit(FULL))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(w * F.col("size")).alias("_mass"), F.count("*").alias("_n"))
    goal = targets(sources.select("source", "source_size"), weights, share, most)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    goal = goal.withColumn("_s", _key(F.col("source"))).join(sources.select(_key(F.col("source")).alias("_s"), "_mass", "_n"), "_s").withColumn("_whole", whole)
    goal = goal.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_bins", F.greatest(F.lit(BINS), F.ceil(F.col("_n") / BIN_ROWS))).drop("_n")
    goal = materialize(goal, "mix-goal")
    rows = placed(sized, goal).filter("_odds IS NOT NULL")
    before = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("_s", "_bin", "_left").agg(F.sum("size").alias("_words")).withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    cut = bins.filter("_base <= _left").groupBy("_s").agg(F.max(F.struct("_bin", "_base")).alias("_cut"))
    inside = Window.partitionBy("_s").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    there = rows.join(cut, "_s").filter(F.col("_bin") == F.col("_cut._bin")).select("_s", "size", "_left", "_cut", _place().alias("_place"))
    there = there.withColumn("_cum", F.col("_cut._base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = there.filter(2 * F.col("_cum") + F.col("size") <= 2 * F.col("_left")).groupBy("_s").agg(F.max("_place").alias("_last"))
    return materialize(goal.join(cut.select("_s", F.col("_cut._bin").alias("_cut")), "_s", "left").join(last, "_s", "left"), "mix-cuts")


def _copies() -> Column:
    more = (F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & (_place() <= F.col("_last")))
    return F.col("_whole") + F.coalesce(more, F.lit(False)).cast("long")


def allocated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, size, source_size, target, copies and taken."""
    sized = materialize(_sized(docs, seed, id_col, text_col, source_col), "mix-sizes")
    rows = placed(sized, cuts(sized, weights, share, most)).withColumn("copies", _copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken (not at all, once or twice)."""
    sized = materialize(_sized(docs, seed, id_col, text_col, source_col), "mix-sizes")
    at = cuts(sized, weights, share, most)
    row = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("_u", uniform("doc_id", seed))
    return placed(row, at).select("_row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select("_row.*")
