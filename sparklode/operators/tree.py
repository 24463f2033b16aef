"""The parent tree: paths, depths, covers, and overlays on a base snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklode.functions.paths import ancestors, parent

LEVELS = 512


def assembled(nodes: DataFrame) -> DataFrame:
    """(node_id, path) -> with parent_id: the row whose path is the parent's, -1 if there is none."""
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_p"))
    return nodes.withColumn("_q", parent(F.col("path"))).join(up, F.col("_q") == F.col("_p"), "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(-1))).drop("_p", "_q")


def parents_counted(nodes: DataFrame) -> DataFrame:
    """(node_id, path) -> (node_id, parents): how many rows have the path of its parent. Rows of equal paths are counted before they are joined, so that many of them cost no more than one."""
    up = nodes.groupBy(F.col("path").alias("_p")).agg(F.count("node_id").alias("_n"))
    rows = nodes.select("node_id", parent(F.col("path")).alias("_q")).groupBy("node_id", "_q").agg(F.count("*").alias("_times"))
    return rows.join(up, F.col("_q") == F.col("_p"), "left").groupBy("node_id").agg(F.sum(F.coalesce("_n", F.lit(0)) * F.col("_times")).alias("parents"))


def resolved(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node_id, parent_id, name) -> (node_id, path, depth), walking down from roots (parent_id -1, whose name is a path)."""
    spark = nodes.sparkSession
    view = f"_nodes_{id(nodes)}"
    nodes.createOrReplaceTempView(view)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", max(levels + 1, 100))
    return spark.sql(f"""
        WITH RECURSIVE walk(node_id, path, depth) AS (
          SELECT node_id, name, length(name) - length(replace(name, '/', '')) FROM {view} WHERE parent_id = -1
          UNION ALL
          SELECT n.node_id, concat(w.path, '/', n.name), w.depth + 1 FROM walk w JOIN {view} n ON n.parent_id = w.node_id)
        SELECT node_id, path, depth FROM walk""")


def covered_by(rows: DataFrame, roots: DataFrame, strict: bool = False) -> DataFrame:
    """Rows joined to the roots above them (``strict``: not themselves): an equi-join on exploded folders, not a comparison of all."""
    up = rows.select("*", F.explode(ancestors(F.col("path"), not strict)).alias("_up"))
    return up.join(roots.select(F.col("path").alias("root")), F.col("_up") == F.col("root")).drop("_up")


def minimal_cover(paths: DataFrame) -> DataFrame:
    """The paths that lie below no other."""
    paths = paths.select("path").distinct()
    under = covered_by(paths, paths, strict=True).select("path").distinct()
    return paths.join(under, "path", "left_anti")


def nearest_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the longest root at or above them; rows without one aren't returned."""
    key = [c for c in rows.columns]
    return covered_by(rows, roots).groupBy(*key).agg(F.max_by("root", F.octet_length("root")).alias("root"))


def dense_parents(paths: DataFrame, least: int = 128) -> DataFrame:
    """Folders with many changed entries right below, the fullest first: candidates for one rescan instead of many."""
    return paths.groupBy(parent(F.col("path")).alias("folder")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def compaction_roots(paths: DataFrame, most: int = 8, uncovered: int = 20_000, least: int = 128, over: int = 30_000, least_depth: int = 3) -> list[str]:
    """The fullest folders, until few enough changes are left outside them. The list read is at most ``most`` long."""
    total = paths.count()
    if total <= over:
        return []
    top = dense_parents(paths, least).filter(F.length("folder") - F.length(F.replace("folder", F.lit("/"), F.lit(""))) >= least_depth).orderBy(F.desc("n"), "folder").limit(most).collect()
    out = []
    for row in top:
        if total <= uncovered:
            break
        out.append(row["folder"])
        total -= row["n"]
    return out


def snapshot(base: DataFrame, subtrees: DataFrame, subtree_rows: DataFrame, exact: DataFrame) -> DataFrame:
    """What is visible of a base under overlays.

    ``subtrees``: (root, preserved array) — a rescan of everything at and below root, but for what is at or below preserved roots.
    ``subtree_rows``: (root, ...) — the rows found. ``exact``: (path, is_complete, present, ...) — single paths; not present is gone,
    and incomplete entries hide nothing.

    A row belongs to the nearest overlay root at or above it that doesn't preserve it; base rows that belong to one are replaced.
    """
    columns = base.columns
    roots = subtrees.select(F.col("root").alias("path"))
    holes = subtrees.select("root", F.explode("preserved").alias("hole"))

    def owners(rows: DataFrame) -> DataFrame:
        """(path, owner): the nearest root above each path that doesn't preserve it. Only paths below a root are joined to holes."""
        at = covered_by(rows.select("path"), roots).distinct()
        kept = covered_by(at.select("path", F.col("root").alias("_at")), holes.select(F.col("hole").alias("path")).distinct()).withColumnRenamed("root", "hole")
        kept = kept.join(holes.withColumnRenamed("root", "_at"), ["hole", "_at"]).select("path", F.col("_at").alias("root"))
        return at.join(kept, ["path", "root"], "left_anti").groupBy("path").agg(F.max_by("root", F.octet_length("root")).alias("owner"))

    done = exact.filter("is_complete")
    old = base.join(owners(base), "path", "left_anti").join(done.select("path"), "path", "left_anti").select(columns)
    mine = subtree_rows.join(owners(subtree_rows), "path").filter("root = owner").join(done.select("path"), "path", "left_anti").select(columns)
    new = done.filter("present").select(columns)
    # These three have no path in common. What was found may name a path twice; a base has each path once.
    return old.unionByName(first_by_path(mine)).unionByName(first_by_path(new)).select(columns)


def invalidated(rows: DataFrame, root: str) -> DataFrame:
    """Rows left when everything at or below ``root`` goes; a range the scan can skip by."""
    p, low = F.col("path"), root.rstrip("/") + "/"
    return rows.filter(~((p == root) | (p >= low) & (p < low[:-1] + "0")))


def overlapping(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows above, at or below one of a few given paths."""
    p, hit = F.col("path"), F.lit(False)
    for x in paths:
        hit = hit | (p == x) | F.startswith(p, F.lit(x.rstrip("/") + "/")) | F.startswith(F.lit(x), F.concat(p, F.lit("/")))
    return rows.filter(hit)


def first_by_path(rows: DataFrame) -> DataFrame:
    """One row a path, that with the smallest node id."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.asc_nulls_last("node_id")))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def admitted(rows: DataFrame, scopes: list[str], ignored: list[str]) -> DataFrame:
    """Rows at or below a scope and not at or below an ignored path (both short lists of settings)."""
    p = F.col("path")
    under = lambda root: (p == root) | F.startswith(p, F.lit(root.rstrip("/") + "/"))
    keep, drop = F.lit(False), F.lit(False)
    for s in scopes:
        keep = keep | under(s)
    for i in ignored:
        drop = drop | under(i)
    return rows.filter(keep & ~drop)


def package_sizes(rows: DataFrame, sizes: DataFrame, least: int = 4096) -> DataFrame:
    """Sizes of packages where one of at least ``least`` bytes is known."""
    known = sizes.filter(F.col("bytes") >= least).select("path", F.col("bytes").alias("_b"))
    return rows.join(known, "path", "left").withColumn("size", F.coalesce("_b", "size")).drop("_b")


def preserved_union(enriched: DataFrame, query_ready: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Enriched rows, and under unresolved roots the earlier ones, the enriched first."""
    old = covered_by(query_ready, unresolved.select("path")).select(query_ready.columns)
    every = enriched.withColumn("_from", F.lit(0)).unionByName(old.withColumn("_from", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("path").orderBy("_from", "node_id"))
    return every.withColumn("_n", n).filter("_n = 1").drop("_n", "_from")


def contiguous_changes(revisions: DataFrame, since: int) -> DataFrame:
    """(rev, path) after ``since``, or nothing if a revision is missing."""
    later = revisions.filter(F.col("rev") > since)
    whole = later.agg((F.coalesce(F.count_distinct("rev") == F.max("rev") - F.lit(since), F.lit(True))).alias("_whole"))
    return later.crossJoin(F.broadcast(whole)).filter("_whole").drop("_whole")  # one row
