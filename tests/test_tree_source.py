"""A folder tree and large files as data sources, and a live index over real folders."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparklode.sources import shared, tree_source
from sparklode.streaming import changes, overlays


@pytest.fixture
def folders(tmp_path):
    for i in range(12):
        at = tmp_path / "top" / f"d{i}" / "deep" / "er"
        at.mkdir(parents=True)
        (at / f"f{i}.txt").write_text("x" * i)
    (tmp_path / "top" / "d0" / ".hid").write_text("")
    os.link(tmp_path / "top" / "d1" / "deep" / "er" / "f1.txt", tmp_path / "top" / "d2" / "same.txt")
    os.symlink(tmp_path / "top", tmp_path / "top" / "d3" / "loop")
    os.symlink(tmp_path / "none", tmp_path / "top" / "d3" / "dangling")
    return str(tmp_path / "top")


def _walk(root):
    out = {root}
    for here, dirs, files in os.walk(root):
        out |= {f"{here}/{x}" for x in dirs + files}
    return out


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_every_path_once(spark, folders, least):
    rows = tree_source.tree(spark, [folders], least).collect()
    assert sorted(r["path"] for r in rows) == sorted(_walk(folders))
    by = {r["path"]: r for r in rows}
    loop = by[f"{folders}/d3/loop"]
    assert loop["is_link"] and not loop["is_dir"] and by[f"{folders}/d3/dangling"]["is_link"]
    assert by[f"{folders}/d5/deep/er/f5.txt"]["size"] == 5 and by[f"{folders}/d0/.hid"]["hidden"] and by[f"{folders}/d4"]["is_dir"] and by[f"{folders}/d4"]["listed"]
    same = {r["path"]: r["aliases"] for r in tree_source.identities(spark.createDataFrame(rows, tree_source.TREE)).collect()}
    assert same[f"{folders}/d1/deep/er/f1.txt"] == 1 and f"{folders}/d2/same.txt" not in same


def test_pushed_paths(spark, folders):
    reader = tree_source.PushingTreeReader({"path": folders})
    f = tree_source.StringStartsWith(("path",), f"{folders}/d1/")
    assert list(reader.pushFilters([f])) == [f] and reader.roots == [f"{folders}/d1"]
    spark.conf.set(tree_source.PUSHDOWN, "true")
    try:
        rows = tree_source.tree(spark, [folders]).filter(F.col("path").startswith(f"{folders}/d1"))
        assert {r["path"] for r in rows.collect()} == {p for p in _walk(folders) if p.startswith(f"{folders}/d1")}
        one = tree_source.tree(spark, [folders]).filter(F.col("path") == f"{folders}/d7/deep")
        assert [r["path"] for r in one.collect()] == [f"{folders}/d7/deep"]
        assert tree_source.tree(spark, [folders]).filter(F.col("path") == "/elsewhere").collect() == []
    finally:
        spark.conf.unset(tree_source.PUSHDOWN)


def test_holes_and_cycles(folders, monkeypatch):
    """What can't be listed is a row that says so, and a folder that is its own ancestor isn't entered."""
    plain = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError()) if str(p).endswith("d2/deep") else plain(p))
    reader = tree_source.TreeReader({"path": folders, "folders": "4"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows if r[-1] is False] == [f"{folders}/d2/deep"]
    assert sorted(r[0] for r in rows) == sorted(p for p in _walk(folders) if not p.startswith(f"{folders}/d2/deep/"))
    info = os.lstat(folders)
    row, files, below = tree_source._listed(folders, ((info.st_dev, info.st_ino),))
    assert row[-1] is False and files == [] and below == []


def test_live_index_over_folders(spark, folders):
    index = overlays.LiveIndex(spark, shared.fresh(spark, "live-tree"))
    columns = ["path", "is_dir", "size"]
    index.create(tree_source.tree(spark, [folders]).select(columns), 4)
    os.remove(f"{folders}/d5/deep/er/f5.txt")
    (lambda p: open(p, "w").write("new"))(f"{folders}/d6/deep/added.txt")
    (lambda p: open(p, "w").write("longer than it was"))(f"{folders}/d7/deep/er/f7.txt")
    os.remove(f"{folders}/d8/deep/er/f8.txt")
    at = datetime(2024, 1, 1)
    events = [(1, f"{folders}/d5", 0x20100, at), (2, f"{folders}/d6/deep", 0x20100, at), (3, f"{folders}/d7/deep/er/f7.txt", 0x11000, at), (4, f"{folders}/d8/deep/er/f8.txt", 0x11000, at)]
    index.apply(spark.createDataFrame(events, changes.EVENT), 0, tree_source.look(spark, columns))
    want = {tuple(r) for r in tree_source.tree(spark, [folders]).select(columns).collect()}
    assert {tuple(r) for r in index.visible().collect()} == want and index.state()["pending"] == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
def test_hits_across_cuts(spark, tmp_path, chunk):
    texts = {"a.txt": "Needle" + "x" * 58 + "needleneedle", "b.txt": "needl", "c.txt": "", "d/e.txt": "é" * 33 + "nEEdle"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"].removeprefix(f"{tmp_path}/"): r["n"] for r in tree_source.literal_hits(spark, str(tmp_path), "needle", chunk).collect()}
    assert got == {n: t.lower().count("needle") for n, t in texts.items() if "needle" in t.lower()}
    assert tree_source.hits(b"aaaa", b"aa", 4) == 3
