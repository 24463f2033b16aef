"""Search over a table of files: name branch, content branch, ranking and pages.

A table of files has node_id, path, name, is_dir, size, modified, created, hidden, in_package and, for content, text.
One query is one plan: filters reach the scan, ranking is a top-k where a limit is given, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sparklode.functions.paths import CONTENT_FOLDERS, depth, extension
from sparklode.operators.ranks import numbered
from sparklode.plans import query as q
from sparklode.plans.compile import Options, compiled, previews, score, visible
from sparklode.sources.shared import kept

#: Rows above which only the head of a broad search is put in order of relevance.
BROAD, HEAD = 100_000, 2_000


def _plain(node: q.Node) -> bool:
    return any(isinstance(n, q.Term) for n, _ in q.leaves(node))


def on_content(node: q.Node, o: Options) -> bool:
    """Whether matches are decided by content: asked for, or forced by a content clause."""
    return q.reads_content(node) or o.target == "content"


def name_matches(files: DataFrame, text: str, o: Options | None = None) -> DataFrame:
    """Visible rows whose name, path and metadata match, with ``score`` of the ranking term (0 without one)."""
    o = o or Options()
    node = q.parse(text)
    wanted = q.ranking_term(node)
    rows = files.filter(visible(o) & compiled(node, o))
    return rows.withColumn("score", score(F.col("name"), wanted) if wanted else F.lit(0))


def content_matches(files: DataFrame, text: str, o: Options | None = None) -> DataFrame:
    """Visible rows whose text matches, with ``preview``: the first line that any positive clause matches, trimmed.

    Rows without a text never match, not even under NOT. A cap on sizes and emptiness are tested before texts are read.
    """
    o = o or Options(target="content")
    node = q.parse(text)
    on_text = o.target == "content" and not q.reads_content(node) or o.target == "both" and not q.reads_content(node)
    candidate = visible(o) & (~F.col("is_dir") | extension(F.col("name")).isin(CONTENT_FOLDERS)) & (F.col("size") > 0)
    if o.max_content_size:
        candidate = candidate & (F.col("size") <= o.max_content_size)
    rows = files.filter(candidate & F.col("text").isNotNull() & compiled(node, o, content=True, plain_on_text=on_text))
    tests = previews(node, o, on_text)
    if not tests:
        return rows.withColumn("preview", F.lit(None).cast("string"))

    def any_of(line: Column) -> Column:
        out = tests[0](line)
        for t in tests[1:]:
            out = out | t(line)
        return out

    return rows.withColumn("preview", F.trim(F.get(F.filter(F.split("text", "\r\n|\n|\r"), any_of), 0)))


def ranked(rows: DataFrame, usage: DataFrame | None = None, by_score: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``rank`` from 1: score, then usage (often, then lately used first), depth, node id. Usage never changes what matches.

    Without a ranking term the order is usage, depth, path. ``limit`` and ``offset`` cut a page after ranking.
    """
    if usage is not None:
        rows = rows.join(usage.select("path", "open_count", "last_opened"), "path", "left")
    else:
        rows = rows.withColumn("open_count", F.lit(None).cast("long")).withColumn("last_opened", F.lit(None).cast("timestamp"))
    last = [depth(F.col("path")), F.col("node_id")] if by_score else [depth(F.col("path")), F.col("path"), F.col("node_id")]
    order = ([F.col("score")] if by_score else []) + [F.col("open_count").desc_nulls_last(), F.col("last_opened").desc_nulls_last(), *last]
    if limit is None:
        rows = numbered(rows, order, kept)
    else:  # a window over a page
        rows = rows.orderBy(*order).limit(limit + offset).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return rows.filter(F.col("rank") > offset) if offset else rows


def search(files: DataFrame, text: str, o: Options | None = None, usage: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The search of the command line: name hits, then content hits that aren't name hits, in one order."""
    o = o or Options()
    node = q.parse(text)
    columns = ["node_id", "path", "name", "is_dir", "size", "modified", "created", "matched_content", "preview", "score"]
    wanted = q.ranking_term(node)
    relevance = score(F.col("name"), wanted) if wanted else F.lit(0)
    names = None
    if not on_content(node, o):
        names = name_matches(files, text, o).withColumn("matched_content", F.lit(False)).withColumn("preview", F.lit(None).cast("string")).select(columns)
    rows = names
    if on_content(node, o) or o.target == "both":
        inside = content_matches(files, text, o).withColumn("matched_content", F.lit(True)).withColumn("score", relevance + (10 if names is not None else 0)).select(columns)
        rows = inside if names is None else names.unionByName(inside.join(names.select("path"), "path", "left_anti").select(columns))
    return ranked(rows, usage, wanted is not None, limit, offset).select("rank", *columns)


def broad_head(rows: DataFrame, head: int = HEAD, broad: int = BROAD, usage: DataFrame | None = None) -> DataFrame:
    """For broad searches: the best ``head`` rows by relevance, the rest in order of node id; up to ``broad`` rows all by relevance."""
    rows = kept(rows)
    if rows.count() <= broad:
        return ranked(rows, usage)
    best = kept(ranked(rows, usage, True, head))
    rest = rows.join(best.select("node_id"), "node_id", "left_anti")
    tail = numbered(rest, [F.col("node_id")], kept).withColumn("rank", F.col("rank") + best.count())
    return best.unionByName(tail, allowMissingColumns=True)


def refilled(rows: DataFrame, order: list[str], there: Callable[[DataFrame], DataFrame], limit: int, after: Row | None = None) -> tuple[DataFrame, Row | None]:
    """(a page of ``limit`` rows that are still there, the place it ends at, for the page after it).

    ``order``: ascending columns without NULL, the last unique. ``there`` gives those of a few rows that are still there. Rows are taken
    in portions of a page from the last place on, until the page is full or the rows end; nothing is looked at beyond that.
    """
    page, n = None, 0
    while True:
        portion = kept((rows if after is None else rows.filter(_beyond(order, after))).orderBy(*order).limit(limit))
        taken = portion.count()
        alive = kept(there(portion).orderBy(*order).limit(limit - n))
        n += alive.count()
        page = alive if page is None else page.unionByName(alive)
        last = alive if n == limit else portion
        after = last.select(*order).orderBy(*(F.desc(c) for c in order)).head() or after
        if n == limit or taken < limit:
            return page, after


def _beyond(order: list[str], after: Row) -> Column:
    out = F.lit(False)
    for c in reversed(order):
        out = (F.col(c) > F.lit(after[c])) | (F.col(c) == F.lit(after[c])) & out
    return out


#: Columns that results may be sorted by.
SORTS = {"name": F.lower, "location": lambda c: F.lower(c), "size": lambda c: c, "modified": lambda c: c, "created": lambda c: c}


#: Results that are handed out together.
NAME_BATCH, CONTENT_BATCH = 16_384, 64


def batches(results: DataFrame, size: int = NAME_BATCH) -> Iterator[list[Row]]:
    """Results in batches, a partition at a time: the caller may stop whenever it has enough."""
    some = results.toLocalIterator(prefetchPartitions=True)
    while part := list(islice(some, size)):
        yield part


def sorted_by(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Results with ``position`` in the order of a column a user chose: name or location without regard to case, size, modified or created; then by node id."""
    key = SORTS[by](F.col({"location": "path"}.get(by, by)))
    return numbered(rows, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("node_id")], kept, "position")


def line_of_all(text: Column, needles: list[str]) -> Column:
    """The first line that holds all of several literals without regard to case, trimmed; NULL if none does."""
    every = lambda line: reduce(Column.__and__, (F.contains(F.lower(line), F.lit(n.lower())) for n in needles), F.lit(True))
    return F.trim(F.get(F.filter(F.split(text, "\r\n|\n|\r"), every), 0))


def score_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("score").agg(F.count("*").alias("n"))


def catalog_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if(F.col("is_dir")).alias("folders"))


def existing(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits that are still there."""
    return rows.join(listing.select("path").distinct(), "path", "left_semi")


def broad_scope(paths: list[str], home: str = "/root") -> bool:
    """Whether a content search over these scopes should be confirmed first."""
    return any(q.normalized(p) in ("/", "/Users", q.normalized(home)) for p in paths)
