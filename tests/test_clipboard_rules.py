from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparklode import queries
from sparklode.functions import text
from sparklode.operators import clipboard, event_log, rules, sessions
from sparklode.sources import catalog

CLIP = "id string, created_at timestamp, preview string, kind string, pinned boolean, title string, bundle string, app string, ocr string, collection string, keyword string, expand boolean"
T0 = datetime(2024, 1, 1)


def _clips(spark, *rows):
    base = {"preview": "", "kind": "text", "pinned": False, "title": None, "bundle": None, "app": None, "ocr": None, "collection": None, "keyword": None, "expand": None}
    return spark.createDataFrame([(str(i), T0 + timedelta(minutes=i), *(base | r).values()) for i, r in enumerate(rows)], CLIP)


def test_structured(spark):
    t = _clips(spark, {"kind": "image", "app": "Google Chrome", "ocr": "Invoice total 42"}, {"kind": "image", "app": "Safari", "ocr": "Invoice total 99"}, {"pinned": True, "collection": "Work Replies", "keyword": "reply"})
    find = lambda q, m="exact": [r["id"] for r in clipboard.search(t, q, m).orderBy("position").collect()]
    assert find('invoice app:"Google Chrome" type:image') == ["0"]
    assert find('is:snippet collection:"Work Replies"') == ["2"]
    assert find("type:nonsense") == []
    assert clipboard.structured('invoice app:"Google Chrome"').text == "invoice"
    assert clipboard.token("app", "Google Chrome") == 'app:"Google Chrome"'


def test_modes(spark):
    t = _clips(spark, {"preview": "Alpha"}, {"preview": "Beta"}, {"preview": "OpenFile"}, {"preview": "Open file data"})
    find = lambda q, m: [r["preview"] for r in clipboard.search(t, q, m).orderBy("position").collect()]
    assert find("^B.ta$", "regex") == ["Beta"] and find("[", "regex") == [] and find("Bta", "mixed") == ["Beta"]
    assert find("ofl", "fuzzy")[0] in ("OpenFile", "Open file data") and find("alpha", "exact") == ["Alpha"] and find("alpha", "regex") == []
    score = spark.range(1).select(clipboard.fuzzy_score(F.lit("abcd"), "bd").alias("a"), clipboard.fuzzy_score(F.lit("abcd"), "ab").alias("b"), clipboard.fuzzy_score(F.lit("abcd"), "dx").alias("c")).first()
    assert tuple(score) == (3, 9, None)
    assert spark.range(1).select(clipboard.ranges(F.lit("Alpha alpha ALPHA"), "alpha")).first()[0] == [1, 7, 13]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.visible_title(F.lit("  first\tline\nsecond  "), True)) == "··first⇥line⏎second··"
    assert one(text.visible_title(F.lit("  first\tline\nsecond  "), False)) == "first\tline second"
    assert one(text.json_minified(F.lit('{"b":2,"a":1}'))) == '{"a":1,"b":2}' and one(text.json_minified(F.lit("{"))) is None
    assert one(text.json_pretty(F.lit('{"b":2,"a":1}'))) == '{\n  "a": 1,\n  "b": 2\n}'
    assert one(text.quoted_lines(F.lit("a\nb"))) == "> a\n> b" and one(text.base64_decoded(F.lit("c3VubGlnaHQ="))) == "sunlight"
    assert one(text.url_encoded(F.lit("a b/c?d=é"))) == "a%20b/c?d=%C3%A9" and one(text.url_decoded(F.lit("a%20b+c"))) == "a b+c"
    assert text.rendered("{date:yyyy-MM-dd} {time:HH:mm} {clipboard}/{{clipboard}} {uuid} A{cursor}BC {x}", datetime(2024, 1, 2, 3, 4), "clip", "U") == ("2024-01-02 03:04 clip/clip U ABC {x}", 30)
    assert one(text.colour(F.lit("#f00"))) == (1.0, 0.0, 0.0, 1.0) and one(text.colour(F.lit("#12"))) is None
    assert one(text.duration(F.lit(3601))) == "1:01" and one(text.duration(F.lit(59.2), True)) == "0:01:00"
    assert one(text.visible_xml(F.lit("<p>a &amp;lt; b</p>"))) == " a &lt; b "
    assert one(text.ip_struct(F.lit("fe80::1%en0")))["family"] == 6 and one(text.ipv4_number(F.lit("1.2.3.256"))) is None
    assert one(text.event_keys(F.lit(0x1800))) == ["Renamed", "Modified"] and one(text.event_keys(F.lit(0))) == ["Changed"]
    kinds = [(0x11000, "exact"), (0x21000, "exact"), (0x20100, "subtree"), (0x10800, "exact"), (0x20800, "subtree"), (0x20400, "metadata"), (0x800, "parent"), (0, "subtree")]
    assert [one(text.event_class(F.lit(f))) for f, _ in kinds] == [k for _, k in kinds]


CRIT = "trigger_id string, ord int, enabled boolean, kind string, op string, number double, number2 double, text string, texts array<string>, flag boolean"
SNAP = "ts timestamp, idle_s double, ssid string, cpu double, battery double, adapter boolean, displays int, builtin_displays int, audio string, ips array<string>, apps array<string>, frontmost array<string>, dns array<string>, volumes array<string>"


def _eval(spark, crit, **snap):
    base = {"ts": datetime(2024, 1, 1, 23), "idle_s": None, "ssid": None, "cpu": None, "battery": None, "adapter": None, "displays": None, "builtin_displays": None, "audio": None, "ips": None, "apps": None, "frontmost": None, "dns": None, "volumes": None} | snap
    full = {"op": None, "number": None, "number2": None, "text": None, "texts": None, "flag": None}
    rows = [(t, o, True, k, *(full | x).values()) for t, o, k, x in crit]
    found = rules.evaluated(spark.createDataFrame([tuple(base.values())], SNAP), spark.createDataFrame(rows, CRIT))
    return {r["trigger_id"]: (r["matched"], r["failed"], r["unavailable"]) for r in found.collect()}, rules.first_matching(found).first()["trigger_id"]


def test_addresses_in_order(spark):
    key = lambda a: spark.range(1).select(text.ip_key(F.lit(a))).first()[0]
    assert key("1.2.3.4") == "401020304" and key("FE80::5%en0") == "6fe80" + "0" * 27 + "5" and key("::") == "6" + "0" * 32
    assert key("::ffff:1.2.3.4") == "6" + "0" * 20 + "ffff01020304" and key("1:2:3:4:5:6:7:8") == "6" + "".join(f"000{i}" for i in range(1, 9))
    assert [key(a) for a in ("1.2.3", "1::2::3", "1:2:3", "12345::", "x", "1:2:3:4:5:6:7::8", "")] == [None] * 7


def test_rules_by_snapshot_and_new_signals(spark):
    crit = [(t, i, True, k, None, None, None, None, x, None) for i, (t, k, x) in enumerate([("v6", "ip", ["fe80::1", "fe80::9"]), ("vpn", "vpn", ["office"]), ("usb", "usb", ["key"])])]
    snaps = spark.createDataFrame([(1, datetime(2024, 1, 1), ["fe80::5"], ["office"]), (2, datetime(2024, 1, 1), ["fe80::a", "10.0.0.1"], None)], "id long, ts timestamp, ips array<string>, vpns array<string>")
    found = rules.evaluated(snaps, spark.createDataFrame(crit, CRIT), "id")
    assert sorted((r["id"], r["trigger_id"], r["matched"]) for r in found.collect()) == [(1, "usb", False), (1, "v6", True), (1, "vpn", True), (2, "usb", False), (2, "v6", False), (2, "vpn", False)]
    assert "Exchange hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()


def test_rules(spark):
    wifi = {"texts": ["home"]}
    assert _eval(spark, [("a", 1, "wifi", wifi)])[0]["a"] == (False, "", "wifi")
    got, first = _eval(spark, [("a", 1, "wifi", wifi), ("a", 1, "cpu", {"op": ">", "number": 5.0}), ("b", 2, "cpu", {"op": ">", "number": 5.0}), ("c", 3, "cpu", {"op": ">", "number": 1.0})], ssid="x", cpu=9.0)
    assert got["a"] == (False, "wifi", "") and first == "b"
    idle = lambda s: _eval(spark, [("i", 1, "idle", {"op": ">", "number": 10.0})], idle_s=s)[0]["i"][0]
    assert idle(601.0) and not idle(540.0)
    night = lambda *d: _eval(spark, [("n", 1, "schedule", {"number": 1320.0, "number2": 120.0, "texts": ["2"]})], ts=datetime(*d))[0]["n"][0]
    assert night(2024, 1, 1, 23) and night(2024, 1, 2, 1) and not night(2024, 1, 2, 3)
    power = lambda how: _eval(spark, [("p", 1, "battery", {"op": ">", "number": 80.0, "text": how})], battery=50.0, adapter=True)[0]["p"][0]
    assert not power("and") and power("or")
    assert _eval(spark, [("d", 1, "displays", {"op": "=", "number": 1.0, "flag": True})], displays=2, builtin_displays=1)[0]["d"][0]


def test_sessions(spark):
    ev = lambda *rows: spark.createDataFrame([("o", T0 + timedelta(seconds=s), i, e) for i, (s, e) in enumerate(rows)], "owner string, ts timestamp, event_id int, event string")
    stat = lambda *r, now=100: tuple(sessions.session_stats(ev(*r), T0 + timedelta(seconds=now)).first())[1:]
    assert stat((0, "started"), (90, "ended")) == (1, 90.0, 90.0)
    assert stat((0, "started"), (30, "replaced"), (60, "ended")) == (1, 60.0, 60.0)
    assert stat((0, "started"), now=5) == (1, 5.0, 5.0)
    pairs = spark.createDataFrame([("p", T0 + timedelta(milliseconds=m), i) for i, m in enumerate((0, 500, 1000, 1500, 9000))], "process string, ts timestamp, event_id int")
    assert {(r["first_id"], r["second_id"]) for r in sessions.merge_pairs(pairs).collect()} == {(0, 1), (2, 3)}


def test_event_log_capacity(spark):
    events = spark.range(20_010).selectExpr("id AS event_id", "2048 AS flags", "concat('/vol/d1/f', id) AS path")
    assert event_log.matching(events, ["renamed", "/d1"]).agg(F.min("event_id"), F.count("*")).first()[:] == (10, 20_000)
    assert event_log.matching(events, ["renamed", "/d1"], capacity=5).count() == 5


def test_event_log_query_searches_the_whole_log(spark):
    sf = "/root/testdata/sf0.01"
    t = F.lower(F.concat_ws(" ", F.array_join(text.event_keys(F.col("flags")), " "), "path"))
    want = catalog.change_events(spark, sf).filter(F.contains(t, F.lit("renamed")) & F.contains(t, F.lit("/d1")))  # 10 000 events, fewer than the log holds
    assert {r[0] for r in queries.QUERIES["event_log_filter"](spark, sf).collect()} == {r[0] for r in want.select("event_id").collect()}


def test_snippet_suffix_takes_all_typed_texts(spark, data):
    words = sorted((f";k{r['conv_id'] % 30}", f"{r['conv_id']}-{r['turn']}") for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn").collect())
    want = set()
    for e in spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id").collect():
        hits = [(-len(k), k, i) for k, i in words if f"say ;k{e['user_id']}".endswith(k)]
        if hits:
            _, k, i = min(hits)
            want.add((e["event_id"], i, k))
    assert {tuple(r) for r in queries.QUERIES["snippet_suffix"](spark, data).select("typed_id", "id", "keyword").collect()} == want


def test_initials_of_common_characters(spark):
    from pyspark.sql import functions as F

    from sparklode.functions.pinyin import initials, table

    assert len(table()[0]) == len(set(table()[0])) == 3755
    words = {"报告": "bg", "总结": "zj", "预算表": "ysb", "啊座": "az", "项目A": "xma", "한": "한"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", initials(F.col("w")).alias("i"))
    assert {r["w"]: r["i"] for r in rows.collect()} == words
