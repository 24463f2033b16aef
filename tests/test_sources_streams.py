import gzip
import io
import tarfile
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from sparklode.sources import extract, tables
from sparklode.streaming import changes


def _zip(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members.items():
            z.writestr(n.replace("__", "/").replace("_DOT_", "."), d)
    return b.getvalue()


def test_extraction(spark, tmp_path):
    assert extract.extracted("a.txt", "héllo".encode("utf-32")) == "héllo"
    assert extract.extracted("a.txt", b"x" * 4096, 1024) is None and extract.extracted("a.pdf", b"%PDF") is None
    assert extract.extracted("a.bin", b"a\0b") is None and extract.extracted("a.txt", b"") is None and extract.extracted("a.txt", b"caf\xe9") == "café"
    assert extract.extracted("a.html", b"<script>x</script><p>a&amp;b</p>").split() == ["a&b"]
    assert extract.extracted("a.zip", _zip(one_DOT_txt="alpha", two_DOT_zip=_zip(in_DOT_txt="hidden"), big_DOT_txt="y")) == "alpha\ny"
    assert extract.extracted("a.zip", _zip(big_DOT_txt="y" * 50), 400) == "y" * 50 and extract.extracted("a.zip", _zip(big_DOT_txt="y" * 5000), 1000) is None
    assert "cell" in extract.extracted("a.xlsx", _zip(xl__sharedStrings_DOT_xml="<t>cell</t>", xl__styles_DOT_xml="<t>no</t>"))
    assert extract.extracted("a.txt.gz", gzip.compress(b"packed")) == "packed" and extract.extracted("b.zip", b"broken") is None
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        info = tarfile.TarInfo("x.md")
        info.size = 2
        t.addfile(info, io.BytesIO(b"md"))
    assert extract.extracted("a.tar.gz", b.getvalue()) == "md"
    (tmp_path / "d" / ".h").mkdir(parents=True)
    (tmp_path / "d" / "n.txt").write_text("needle here")
    (tmp_path / "d" / ".h" / "z.bin").write_bytes(b"\0")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in extract.texts(extract.binary_files(spark, str(tmp_path / "d"))).collect()}
    assert got["n.txt"] == "needle here"
    flags = {r["name"]: r["hidden"] for r in extract.scanned(spark, str(tmp_path / "d")).collect()}
    assert not flags["n.txt"] or "/." in str(tmp_path)


def test_stores(spark, files, tmp_path):
    t = files("a.txt", "b.txt")
    tables.save_snapshot(t, str(tmp_path / "s"), 7)
    assert tables.load_snapshot(spark, str(tmp_path / "s")).count() == 2
    tables.append_journal(spark.createDataFrame([(8, "exact", "/a")], "event_id long, kind string, path string"), str(tmp_path / "j"), 7)
    assert tables.load_journal(spark, str(tmp_path / "j"), 7).count() == 1 and tables.load_journal(spark, str(tmp_path / "j"), 6).count() == 0
    h = spark.createDataFrame([("1", "x", 2), ("2", None, 3)], "id string, preview string, n int")
    closed = tables.encrypted(h, "0123456789abcdef")
    assert sorted(map(tuple, tables.decrypted(closed, "0123456789abcdef", "preview string, n int").collect())) == sorted(map(tuple, h.collect()))
    assert tables.decrypted(closed, "x" * 16, "preview string, n int").count() == 0
    up, gone = tables.changed_rows(h, spark.createDataFrame([("1", "y", 2)], h.schema))
    assert up.count() == 1 and [r["id"] for r in gone.collect()] == ["2"]


def test_batch_work(spark):
    rows = [(1, "/a/f", 0x11000), (2, "/a", 0x20100), (3, "/b/f", 0x11000), (4, "/b/f", 0x11000), (5, "/c/x", 0x800), (6, "/.docid/1/changed/2/src=1,dst=2", 0x11000), (7, None, 0), (8, "/private/var/q", 0x11000)]
    got = {(r["kind"], r["path"], r["event_id"]) for r in changes.batch_work(spark.createDataFrame(rows, "event_id long, path string, flags int")).collect()}
    assert got == {("subtree", "/a", 2), ("exact", "/b/f", 4), ("subtree", "/c", 5), ("exact", "/var/q", 8)}


def test_captured_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), datetime(2024, 1, 1, 0, i), f"c{i % 3}", "app") for i in range(9)]
    src = spark.createDataFrame(rows, "id string, ts timestamp, content string, app string")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.captured(stream, spark, str(tmp_path / "h"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination(120)
    last = max(p.name for p in (tmp_path / "h").iterdir() if p.name.startswith("v"))
    assert sorted(r["copies"] for r in spark.read.parquet(str(tmp_path / "h" / last)).collect()) == [3, 3, 3]


def test_switches_stream(spark, tmp_path):
    rows = [("o", datetime(2024, 1, 1, 0, i), t) for i, t in enumerate(["a", "a", None, "b", "c", None])]
    spark.createDataFrame(rows, "owner string, ts timestamp, trigger_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner string, ts timestamp, trigger_id string").parquet(str(tmp_path / "in"))
    q = changes.switches(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [r["action"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()] == ["start", "end", "start", "switch", "end"]


def test_long_journals_are_read_whole(spark, tmp_path):
    rows = spark.range(500_001).select(F.col("id").alias("event_id"), F.lit("exact").alias("kind"), F.lit("/a").alias("path"))
    tables.append_journal(rows, str(tmp_path / "j"), 7)
    assert tables.load_journal(spark, str(tmp_path / "j"), 7).count() == 500_001
    assert tables.load_journal(spark, str(tmp_path / "j"), 7, 500_000).count() == 0
