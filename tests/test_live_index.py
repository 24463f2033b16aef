"""The live index: which entry of the log decides, holes, retries that wait, compaction, freshness."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparklode.functions.paths import ancestors
from sparklode.sources import shared
from sparklode.streaming import changes, overlays

T0 = datetime(2024, 1, 1)
EXACT, FOLDER = 0x11000, 0x20100


class Disk:
    """What is there, and what can't be read; ``look`` sees it as it is when a batch runs."""

    def __init__(self, spark):
        self.spark, self.files, self.closed = spark, {}, set()

    def look(self, work):
        disk = self.spark.createDataFrame(list(self.files.items()), "path string, size long")
        shut = self.spark.createDataFrame([(c,) for c in self.closed], "hole string")
        under = lambda rows, column: rows.select("*", F.explode(ancestors(F.col(column))).alias("hole")).join(shut, "hole", "left_semi").select(column).distinct()
        deep, single = work.filter("kind = 'subtree'").select(F.col("path").alias("root")), work.filter("kind = 'exact'").select("path")
        below = disk.join(under(disk, "path"), "path", "left_anti").select("*", F.explode(ancestors(F.col("path"))).alias("root")).join(deep, "root").withColumns({"present": F.lit(True), "is_complete": F.lit(True)})
        lost = under(single, "path").withColumn("_lost", F.lit(True))
        here = single.join(disk.withColumn("present", F.lit(True)), "path", "left").join(lost, "path", "left")
        here = here.withColumns({"present": F.coalesce("present", F.lit(False)), "is_complete": F.col("_lost").isNull(), "root": F.col("path")}).drop("_lost")
        inside = shut.select("hole", F.explode(ancestors(F.col("hole"))).alias("root")).join(deep, "root").select("root", "hole")
        return below.unionByName(here), inside


@pytest.fixture
def live(spark):
    disk = Disk(spark)
    index = overlays.LiveIndex(spark, shared.fresh(spark, "live-test"))
    old = {f"/{a}/{b}/f{i}": 1 for a in "abcd" for b in "xy" for i in range(3)}
    index.create(spark.createDataFrame(list(old.items()), "path string, size long"), 4)
    number = [0]

    def batch(*events, minutes=0, **most):
        rows = [(100 * number[0] + i + 1, p, f, T0 + timedelta(minutes=minutes)) for i, (p, f) in enumerate(events)]
        index.apply(spark.createDataFrame(rows, changes.EVENT), number[0], disk.look, **most)
        number[0] += 1
        return dict(map(tuple, index.visible().collect()))

    return disk, index, batch, old


def test_newest_entry_decides_but_in_holes(live):
    disk, index, batch, old = live
    disk.files = {"/a/x/f0": 2, "/a/y/new": 2, "/b/x/f0": 2}
    assert batch(("/a", FOLDER)) == {p: s for p, s in old.items() if not p.startswith("/a/")} | {"/a/x/f0": 2, "/a/y/new": 2}
    # A single file after the scan, one that is gone, one that isn't in the base.
    disk.files |= {"/a/x/f1": 3, "/c/new": 3}
    seen = batch(("/a/x/f1", EXACT), ("/b/y/f0", EXACT), ("/c/new", EXACT))
    assert seen["/a/x/f1"] == 3 and seen["/c/new"] == 3 and "/b/y/f0" not in seen and seen["/b/x/f0"] == 1
    # An inner scan with a hole: in it the outer scan of the first batch still decides, outside it no longer.
    disk.files = {"/a/x/f0": 4, "/a/y/other": 4}
    disk.closed = {"/a/y"}
    seen = batch(("/a", FOLDER))
    assert {p: s for p, s in seen.items() if p.startswith("/a/")} == {"/a/x/f0": 4, "/a/y/new": 2}
    assert index.state()["pending"] == 1 and index.state()["checkpoint"] == 103 and index.state()["seen"] == 201
    # A folder whose root itself can't be listed hides nothing, and so does a file that can't be looked at.
    disk.closed |= {"/d"}
    seen = batch(("/d", FOLDER), ("/d/x/f0", EXACT))
    assert {p: s for p, s in seen.items() if p.startswith("/d/")} == {p: 1 for p in old if p.startswith("/d/")}
    # A scan above removes what was below.
    disk.closed, disk.files = set(), {"/a/only": 5}
    seen = batch(("/a", FOLDER), ("/d", FOLDER))
    assert {p: s for p, s in seen.items() if p[:3] in ("/a/", "/d/")} == {"/a/only": 5}
    assert index.state()["pending"] == 0 and index.state()["checkpoint"] == index.state()["seen"]


def test_retries_wait(live):
    disk, index, batch, _ = live
    disk.closed, disk.files = {"/a/x/f0"}, {"/a/x/f0": 7}
    waits = lambda: {r["path"]: (r["tries"], r["next_at"]) for r in index._log("retry", "", index.state()["batch"], index.state()["batch"]).collect()}
    batch(("/a/x/f0", EXACT))
    assert waits() == {"/a/x/f0": (1, T0 + timedelta(seconds=5))}
    disk.closed = set()
    assert batch(("/b/none", EXACT))["/a/x/f0"] == 1 and set(waits()) == {"/a/x/f0"}  # not due yet
    disk.closed = {"/a/x/f0"}
    batch(("/b/none", EXACT), minutes=1)
    assert waits() == {"/a/x/f0": (2, T0 + timedelta(minutes=1, seconds=10))}
    disk.closed = set()
    assert batch(("/b/none", EXACT), minutes=2)["/a/x/f0"] == 7 and waits() == {}


def test_compaction_writes_only_what_the_log_reaches(live):
    disk, index, batch, old = live
    disk.files = {"/a/x/f0": 2, "/a/x/more": 2}
    before = batch(("/a/x", FOLDER), ("/c/y/f1", EXACT))
    first = {m[0]: m[2] for m in index.manifest(0)}
    after = batch(("/a/x/f0", EXACT), exact_most=1)
    assert after == before and index.state()["gen"] == 2 and index.state()["log_from"] == 2
    second = {m[0]: m[2] for m in index.manifest(2)}
    assert set(second) == set(first) and 1 <= sum(g == 2 for g in second.values()) <= 2 and any(g == 0 for g in second.values())
    assert {n for n in shared.names(index.spark, f"{index.at}/base")} == {"gen=0", "gen=2"} and shared.names(index.spark, f"{index.at}/manifest") == ["v=0", "v=2"]
    disk.files = {}
    assert batch(("/d", FOLDER)) == {p: s for p, s in after.items() if not p.startswith("/d/")}
    # The same batch again gives the same.
    index.apply(index.spark.createDataFrame([(900, "/d", FOLDER, T0)], changes.EVENT), 2, disk.look)
    assert dict(map(tuple, index.visible().collect())) == {p: s for p, s in after.items() if not p.startswith("/d/")}
    assert {tuple(r) for r in index.changed_since(0).collect()} == {("/a/x/f0", False), ("/d", True)}
    assert index.changed_since(-20) is None


def test_freshness(spark):
    rows = spark.createDataFrame([("/a/f",), ("/a/b/g",), ("/c",)], "path string")
    asked = spark.createDataFrame([("subtree", "/a/b", 5), ("exact", "/a/f", 9), ("exact", "/a", 20)], "kind string, path string, event_id long")
    fresh = lambda n, *lost: {r["path"] for r in overlays.freshness(rows, asked, n, spark.createDataFrame([(x,) for x in lost], "path string")).filter("fresh").collect()}
    assert fresh(0) == {"/c"} and fresh(5) == {"/a/b/g", "/c"} and fresh(30) == {"/a/f", "/a/b/g", "/c"} and fresh(30, "/a/b") == {"/a/f", "/c"}
    meta = spark.createDataFrame([("/a/f", 9), ("/a/b/g", 4), ("/c", 0)], "path string, indexed long")
    assert {r["path"] for r in overlays.content_kept(meta, asked).collect()} == {"/a/f", "/c"}
