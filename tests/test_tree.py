import pytest
from pyspark.sql import functions as F

from sparklode.operators import tree

ROWS = "node_id long, path string"


def _snapshot(spark, base, subtrees, rows, exact=()):
    ids = {}
    row = lambda p: (ids.setdefault(p, len(ids)), p)
    b = spark.createDataFrame([row(p) for p in base], ROWS)
    s = spark.createDataFrame(list(subtrees), "root string, preserved array<string>")
    r = spark.createDataFrame([(*row(p), root) for root, p in rows], ROWS + ", root string")
    e = spark.createDataFrame([(*row(p), done, there) for p, there, done in exact], ROWS + ", is_complete boolean, present boolean")
    return {x["path"] for x in tree.snapshot(b, s, r, e).collect()}


def test_overlays(spark):
    go = lambda *a: _snapshot(spark, *a)
    assert go(["/c/old", "/s/x"], [("/c", [])], [("/c", "/c/new")]) == {"/c/new", "/s/x"}
    assert go(["/e/old", "/e/stable"], [], [], [("/e/old", False, True), ("/e/new", True, True), ("/e/stable", False, False)]) == {"/e/new", "/e/stable"}
    assert go(["/p/stable", "/p/child/old"], [("/p", []), ("/p/child", [])], [("/p", "/p/stable"), ("/p", "/p/child/old"), ("/p/child", "/p/child/new")]) == {"/p/stable", "/p/child/new"}
    assert go(["/c/u/kept", "/c/removed"], [("/c", ["/c/u"])], [("/c", "/c/new")]) == {"/c/u/kept", "/c/new"}
    assert go(["/p/child/old"], [("/p", ["/p/child"]), ("/p/child", [])], [("/p/child", "/p/child/new")]) == {"/p/child/new"}
    got = go(["/p/c/u/gone"], [("/p", []), ("/p/c", ["/p/c/u"])], [("/p", "/p/c/u/fresher"), ("/p/c", "/p/c/new")])
    assert got == {"/p/c/u/fresher", "/p/c/new"}


@pytest.mark.parametrize(("given", "kept"), [(["/a/b/file.txt", "/a", "/z.txt", "/a/outside"], {"/a", "/z.txt"}), (["/a/b/c/r.txt", "/a/b-older", "/a/b"], {"/a/b", "/a/b-older"})])
def test_minimal_cover(spark, given, kept):
    assert {r["path"] for r in tree.minimal_cover(spark.createDataFrame([(p,) for p in given], "path string")).collect()} == kept


def test_compaction_roots(spark):
    paths = spark.createDataFrame([(f"/a/b/c/d/{i}",) for i in range(80)] + [(f"/x{i}/y/z",) for i in range(20)], "path string")
    assert tree.compaction_roots(paths, 4, 20, 64, 50) == ["/a/b/c/d"]
    assert tree.compaction_roots(spark.createDataFrame([(f"/home/{i}",) for i in range(100)], "path string"), 4, 20, 64, 50) == []


def test_invalidate_respects_boundaries(spark):
    rows = spark.createDataFrame([(p,) for p in ("/f/inside", "/f/nested/deep", "/f0/sibling", "/fish/outside", "/f")], "path string")
    assert {r[0] for r in tree.invalidated(rows, "/f").collect()} == {"/f0/sibling", "/fish/outside"}


def test_resolved_and_cycles_of_names(spark):
    nodes = spark.createDataFrame([(0, -1, "/r"), (1, 0, "a"), (2, 1, "b"), (3, 1, "c")], "node_id long, parent_id long, name string")
    assert {(r["path"], r["depth"]) for r in tree.resolved(nodes).collect()} == {("/r", 1), ("/r/a", 2), ("/r/a/b", 3), ("/r/a/c", 3)}


def test_contiguous_changes(spark):
    revs = spark.createDataFrame([(2, "/a"), (3, "/b"), (5, "/c")], "rev long, path string")
    assert tree.contiguous_changes(revs, 1).count() == 0
    assert tree.contiguous_changes(revs.filter(F.col("rev") < 4), 1).count() == 2


def test_parents_of_equal_paths_are_counted(spark):
    """A folder that is there many times, with many entries in it: 20 000 rows a side make no 400 million pairs."""
    n = 20_000
    nodes = spark.range(n).select("id", F.lit("/a").alias("path")).union(spark.range(n).select(F.col("id") + n, F.concat(F.lit("/a/"), "id"))).toDF("node_id", "path")
    nodes = nodes.union(spark.createDataFrame([(5, "/a/x"), (None, "/a"), (None, None), (7, "/b/y"), (8, "/a/x/z")], "node_id long, path string"))
    counts = tree.parents_counted(nodes)
    assert "NestedLoop" not in counts._jdf.queryExecution().toString()
    got = {r["node_id"]: r["parents"] for r in counts.collect()}
    assert len(got) == 2 * n + 1
    assert got[5] == n and got[7] == 0 and got[8] == 1 and got[None] == 0 and got[0] == 0 and got[n] == n and sum(got.values()) == n * (n + 1) + 1
