"""Ranks by ranges, pages refilled, stored indexes, compiled rules, templates as a column, and imports that clash."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from sparklode.functions import text
from sparklode.operators import clipboard, content_index, ranks, rules, search
from sparklode.queries_more import QUERIES
from sparklode.sources import catalog, shared
from sparklode.streaming import building


def test_numbers_are_the_same_in_one_task_and_by_ranges(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(i, rnd.choice([None, 1, 2, 3]), rnd.random()) for i in range(500)], "id long, a int, b double")
    order = [F.col("a").desc_nulls_last(), F.col("b"), F.col("id")]
    one = ranks.numbered(rows, order, shared.kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = ranks.numbered(rows, order, shared.kept, one_task=0)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
        assert ranks.numbered(rows.limit(0), order, shared.kept, one_task=-1).collect() == []
        dealt = ranks.Pieces(rows.withColumn("g", F.col("id") % 3), ["g"], [F.col("b")], shared.kept)
        got = dealt.running({"n": ("sum", F.lit(1)), "low": ("min", F.col("b")), "x": ("xor", F.col("id"))}, more="more").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["b"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1)) and [r["more"] for r in mine] == [True] * (len(mine) - 1) + [False]
        x = 0
        for r in mine:
            x ^= r["id"]
            assert r["x"] == x and r["low"] == mine[0]["b"]


def test_broad_head(spark, files):
    rows = files(*[f"{'x/' * (i % 4)}{'a' if i % 3 else 'ab'}{i}" for i in range(40)]).withColumn("score", F.length("name") % 3)
    full = [r["node_id"] for r in search.broad_head(rows, 5, 40).orderBy("rank").collect()]
    head = [r["node_id"] for r in search.broad_head(rows, 5, 39).orderBy("rank").collect()]
    assert head[:5] == full[:5] and head[5:] == sorted(head[5:]) and sorted(head) == sorted(full)


def test_pages_go_on_where_they_ended(spark):
    rows = spark.createDataFrame([(i // 7, i) for i in range(200)], "depth int, node_id int")
    there = lambda part: part.filter("node_id % 5 = 0 OR node_id > 190")
    want = [i for i in range(200) if i % 5 == 0 or i > 190]
    got, after = [], None
    for _ in range(8):
        page, after = search.refilled(rows, ["depth", "node_id"], there, 9, after)
        got.append(sorted(r["node_id"] for r in page.collect()))
    assert [len(p) for p in got] == [9, 9, 9, 9, 9, 3, 0, 0] and [i for p in got for i in p] == want
    empty, after = search.refilled(rows.limit(0), ["depth", "node_id"], there, 9)
    assert empty.collect() == [] and after is None


def test_stored_postings(spark):
    texts = ["The cat", "cat", "concatenate", "ca", "", None, "Çat ÇATS", "the end the end", "a cat\nnap"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = shared.fresh(spark, "postings-test")
    content_index.store_postings(content_index.postings(docs), at, 4, 2)
    for literal in ("cat", "CAT", "çat", "the end", "ca", "nothing here", "t\nn"):
        want = {i for i, t in enumerate(texts) if t is not None and literal.lower() in t.lower()}
        stored = content_index.stored_postings(spark, at, literal, 4)
        if len(literal) > 2:
            assert {r["doc_id"] for r in content_index.found(docs, stored, literal).collect()} == want
        assert {r["doc_id"] for r in content_index.found(docs, None, literal).collect()} == want or len(literal) < 3
    plan = content_index.stored_postings(spark, at, "cat", 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace("In(bucket", "[bucket") or "PartitionFilters: [" in plan


def test_signatures_leave_blocks_out(spark):
    names = spark.createDataFrame([(i, f"{'Zebra' if i % 160 == 7 else 'horse'}-{i}.txt") for i in range(640)] + [(640, ""), (641, "Ünï")], "node_id long, name string")
    s = content_index.signature(names)
    assert {r["node_id"] for r in content_index.names_with(names, s, "zebra").collect()} == {7, 167, 327, 487}
    assert {r["node_id"] for r in content_index.names_with(names, s, "ünï").collect()} == {641}
    assert content_index.blocks_with(s, "zebra").count() <= 8 and s.count() == 41


def test_compiled_rules_say_what_interpreted_ones_say(spark):
    from sparklode.queries import _rules

    snaps, criteria = _rules(spark, "/root/testdata/sf0.001")
    more = spark.createDataFrame([("odd", 9, True, "unknown", None, None, None, None, None, None), ("two", 8, True, "battery", "<", 20.0, None, "and", None, None), ("two", 8, True, "battery", ">", 5.0, None, None, None, None), ("six", 7, True, "ip", None, None, None, None, ["::ffff:10.0.0.1", "::ffff:10.0.0.99"], None)], criteria.schema)
    both = [sorted(map(tuple, rules.evaluated(snaps, criteria.union(more), "event_id", n).collect())) for n in (200, 0)]
    assert both[0] == both[1] and len({r[1] for r in both[0]}) == 6
    assert rules.evaluated(snaps, criteria.limit(0), "event_id").collect() == []
    for a in ("10.0.0.1", "::1", "fe80::1%en0", "::ffff:1.2.3.4", "1.2.3", "", None, "1::2::3"):
        assert spark.createDataFrame([(a,)], "a string").select(text.ip_key(F.col("a"))).head()[0] == text.ip_key_of(a), a


def test_templates_as_a_column(spark):
    now = datetime(2024, 3, 5, 14, 7, 9)
    templates = ["", "plain", "{date} {time} {datetime}", "{{date:dd/MM}}{ time : x }{time:HH.mm.ss}", "{cursor}a{cursor}", "{{cursor}}", "{clipboard}{uuid}", "{x} {{y}} { } }{", "{datetime:yyyy}", "a{date}b{cursor}c", "{date:}"]
    rows = spark.createDataFrame([(t, now) for t in templates] + [(None, now)], "t string, now timestamp")
    r = text.rendered_rows(F.col("t"), F.col("now"), F.lit("CLIP"), F.lit("U-1"))
    got = {x[0]: (x[1], x[2]) for x in rows.select("t", r["text"], r["cursor"]).collect()}
    assert got.pop(None) == (None, None)
    assert got == {t: text.rendered(t, now, "CLIP", "U-1") for t in templates}


def test_imports_that_clash(spark):
    kinds = "id string, pinned boolean, title string, preview string, keyword string, collection string"
    history = spark.createDataFrame([("a", False, "t", "p", None, None), ("a-2", True, "t", "p", ";k", None), ("a-3", False, "t", "p", None, None), ("b", True, "t", "p", ";b", None)], kinds)
    records = spark.createDataFrame([("a", "n", "q", ";new", None), ("b", "n", "q", ";B", None), ("c", "n", "q", ";K", None), ("d", "n", "q", ";d", None), ("e", "n", "q", ";D", None)], "id string, title string, preview string, keyword string, collection string")
    assert {r["id"] for r in clipboard.refused(history, records).collect()} == {"c", "d", "e"}
    got = {r["id"]: (r["pinned"], r["title"]) for r in clipboard.snippet_merge(history, records).collect()}
    assert got == {"a": (False, "t"), "a-2": (True, "t"), "a-3": (False, "t"), "a-4": (True, "n"), "b": (True, "n")}


def test_partial_results_stop_growing(spark):
    at, table = shared.fresh(spark, "built"), shared.fresh(spark, "partial")
    for k in range(4):
        spark.createDataFrame([(f"/{i}", 10 * k + i) for i in range(k, k + 3)], "path string, node_id long").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("path string, node_id long").option("maxFilesPerTrigger", 1).parquet(at)
    q = building.published(stream, table, shared.fresh(spark, "checkpoint"), {"availableNow": True}, most=5)
    q.awaitTermination(120)
    rows = building.snapshot(spark, table, "struct<path:string,node_id:bigint>").collect()
    assert sorted((r["path"], r["node_id"], r["batch"]) for r in rows) == [("/0", 0, 0), ("/1", 1, 0), ("/2", 2, 0), ("/3", 13, 1), ("/4", 24, 2)]


def test_small_columns(spark):
    row = spark.range(1)
    of = lambda c: row.select(c.alias("v")).head()["v"]
    kinds = {"public.png": "image", "public.file-url": "file", "public.rtf": "richText", "public.url": "text", "x": "other"}
    assert {k: of(clipboard.storage_category(F.lit(k))) for k in kinds} == kinds
    bad = F.create_map(F.lit("public.utf8-plain-text"), F.lit(b"\xff\xfe\xfd"), F.lit("public.url"), F.lit(b"u:v"))
    assert of(clipboard.plain_text(bad)) == "u:v" and of(clipboard.plain_text(F.create_map(F.lit("z"), F.lit(b"z")), F.lit("seen"))) == "seen"
    assert tuple(of(clipboard.stack_progress(F.array(), F.lit(3)))) == (0, 0, 0.0)
    assert of(search.line_of_all(F.lit("one two\r\n two THREE one \nx"), ["three", "ONE"])) == "two THREE one"


def test_partial_results_are_whole_when_the_build_ends(spark, monkeypatch):
    at, table = shared.fresh(spark, "built"), shared.fresh(spark, "partial")
    for k in range(4):
        spark.createDataFrame([(f"/{i}" if i != 2 else None, 10 * k + i) for i in range(k, k + 3)], "path string, node_id long").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("path string, node_id long").option("maxFilesPerTrigger", 1).parquet(at)
    building.published(stream, table, shared.fresh(spark, "checkpoint"), {"availableNow": True}, most=4).awaitTermination(120)
    schema = "struct<path:string,node_id:bigint>"
    assert building.snapshot(spark, table, schema).count() == 4
    for _ in range(2):
        building.ended(spark, table, schema)
        rows = building.snapshot(spark, table, schema).collect()
        assert sorted((r["path"] or "", r["node_id"]) for r in rows) == [("", 2), ("/0", 0), ("/1", 1), ("/3", 13), ("/4", 24), ("/5", 35)]
    monkeypatch.setattr(building.published, "__defaults__", (None, 1))
    got = QUERIES["partial_snapshot_stream"](spark, "/root/testdata/sf0.001")
    want = catalog.change_events(spark, "/root/testdata/sf0.001").groupBy("path").agg(F.min("event_id").alias("node_id"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
