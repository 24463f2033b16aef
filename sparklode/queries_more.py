"""Queries for sorts, pages, stored indexes, stores, clipboard entries and the parts of the search language that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.functions import text
from sparklode.operators import clipboard, content_index, event_log, rules, search, sessions, tree, usage
from sparklode.plans import query as q
from sparklode.plans.compile import Options, compiled
from sparklode.queries import CLIPS, DEPTH, EVENTS, FILES, NOW, PARTS, VISIBLE, _search, query
from sparklode.queries_live import QUERIES, SQL, landed
from sparklode.sources import catalog, shared, tables
from sparklode.streaming import building, changes

__all__ = ["QUERIES", "SQL"]


def _table(spark, sf_dir, name) -> DataFrame:
    return catalog.table(spark, sf_dir, name)


# ---------------------------------------------------------------- sorts and pages

@query(f"WITH {PARTS} SELECT node_id, row_number() OVER (ORDER BY size DESC, node_id)::INT AS position FROM files WHERE {VISIBLE} AND contains(lower(name), 'ring')")
def results_by_size(spark, sf_dir):
    return search.sorted_by(search.name_matches(catalog.parts(spark, sf_dir), "ring", Options(now=NOW)).select("node_id", "size"), "size", True).select("node_id", "position")


@query(f"WITH {PARTS} SELECT node_id, row_number() OVER (ORDER BY lower(path), node_id)::INT AS position FROM files WHERE {VISIBLE} AND contains(lower(name), 'ring')")
def results_by_location(spark, sf_dir):
    return search.sorted_by(search.name_matches(catalog.parts(spark, sf_dir), "ring", Options(now=NOW)).select("node_id", "path"), "location").select("node_id", "position")


@query(f"WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY lower(regexp_extract(path, '[^/]*$')), event_id DESC)::INT AS position FROM fs")
def events_by_name(spark, sf_dir):
    return event_log.sorted_by(catalog.change_events(spark, sf_dir), "name").select("event_id", "position")


@query(f"WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC)::INT AS position FROM fs")
def events_by_time(spark, sf_dir):
    return event_log.sorted_by(catalog.change_events(spark, sf_dir), "time", True).select("event_id", "position")


@query("SELECT max(event_id) AS last_id FROM events")
def last_event(spark, sf_dir):
    return event_log.last_id(_table(spark, sf_dir, "events"))


@query(f"WITH {CLIPS} SELECT id, row_number() OVER (ORDER BY lower(coalesce(collection, '')), lower(coalesce(title, '')), id)::INT AS position FROM clips WHERE pinned")
def snippet_order(spark, sf_dir):
    return clipboard.snippet_list(catalog.clipboard(spark, sf_dir)).select("id", "position")


@query("SELECT DISTINCT source AS collection FROM documents WHERE source IS NOT NULL")
def collection_names(spark, sf_dir):
    return clipboard.collections(_table(spark, sf_dir, "documents").select(F.col("source").alias("collection")))


# Every third row is gone since: the second page of 100 goes on where the first ended.
@query(f"""WITH {PARTS}, hits AS (SELECT node_id, {DEPTH} AS depth FROM files WHERE {VISIBLE} AND contains(lower(name), 'e') AND node_id % 3 <> 0)
SELECT node_id FROM hits ORDER BY depth, node_id LIMIT 100 OFFSET 100""")
def page_refilled(spark, sf_dir):
    rows = search.name_matches(catalog.parts(spark, sf_dir), "e", Options(now=NOW))
    rows = rows.select("node_id", search.depth(F.col("path")).alias("depth"))
    there = lambda part: part.filter("node_id % 3 != 0")
    _, after = search.refilled(rows, ["depth", "node_id"], there, 100)
    return search.refilled(rows, ["depth", "node_id"], there, 100, after)[0].select("node_id")


@query(rf"""SELECT doc_id, trim(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda l: contains(lower(l), 'the') AND contains(lower(l), 'on'))[1]) AS line FROM documents""")
def line_of_all(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", search.line_of_all(F.col("text"), ["the", "ON"]).alias("line"))


# ---------------------------------------------------------------- stored indexes

@query("""SELECT doc_id, word FROM documents, (SELECT unnest(['worthless', 'moron', 'token=']) AS word) WHERE contains(lower(text), word)""")
def stored_postings_search(spark, sf_dir):
    """Postings are stored once and serve several literals; each reads the buckets of its trigrams."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    at = shared.fresh(spark, "postings")
    content_index.store_postings(content_index.postings(d), at, 16)
    out = None
    for word in ("worthless", "moron", "token="):
        hits = content_index.found(d, content_index.stored_postings(spark, at, word, 16), word).select("doc_id", F.lit(word).alias("word"))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(f"WITH {PARTS} SELECT node_id FROM files WHERE contains(lower(name), 'olive')")
def signature_search(spark, sf_dir):
    p = catalog.parts(spark, sf_dir).select("node_id", "name")
    return content_index.names_with(p, content_index.signature(p), "OLive").select("node_id")


@query(f"WITH {EVENTS} SELECT path, min(event_id) AS node_id FROM fs GROUP BY path")
def partial_snapshot_stream(spark, sf_dir):
    """What a build writes, published as it goes, and what waited when it has ended: each path once."""
    at = shared.fresh(spark, "landing")
    rows = catalog.change_events(spark, sf_dir).select("path", F.col("event_id").alias("node_id"))
    step = max((rows.agg(F.max("node_id")).head()[0] or 0) // 3 + 1, 1)
    third = F.coalesce(F.greatest(F.least(F.floor(F.col("node_id") / step), F.lit(2)), F.lit(0)), F.lit(2))
    table, checkpoint = shared.fresh(spark, "partial"), shared.fresh(spark, "checkpoint")
    for k in range(3):
        rows.filter(third == k).write.mode("append").parquet(at)
        building.published(spark.readStream.schema(rows.schema).parquet(at), table, checkpoint, {"availableNow": True}).awaitTermination()
    building.ended(spark, table, rows.schema.simpleString())
    return building.snapshot(spark, table, rows.schema.simpleString()).select("path", "node_id")


# ---------------------------------------------------------------- stores

@query(f"WITH {FILES} SELECT node_id, path, size, 41::BIGINT AS base_event_id FROM files")
def snapshot_round_trip(spark, sf_dir):
    at = shared.fresh(spark, "snapshot")
    tables.save_snapshot(catalog.files(spark, sf_dir).select("node_id", "path", "name", "size"), at, 41)
    return tables.load_snapshot(spark, at).select("node_id", "path", "size", "base_event_id")


@query(f"WITH {EVENTS} SELECT event_id, 'exact' AS kind, path FROM fs WHERE event_id % 2 = 0")
def journal_round_trip(spark, sf_dir):
    """Changes after two bases; those of one are read."""
    at = shared.fresh(spark, "journal")
    e = catalog.change_events(spark, sf_dir).select("event_id", F.lit("exact").alias("kind"), "path")
    tables.append_journal(e.filter("event_id % 2 = 0"), at, 10)
    tables.append_journal(e.filter("event_id % 2 = 1"), at, 11)
    return tables.load_journal(spark, at, 10).select("event_id", "kind", "path")


@query(f"WITH {CLIPS} SELECT id, preview, kind FROM clips")
def encrypted_round_trip(spark, sf_dir):
    at = shared.fresh(spark, "encrypted")
    key = "0123456789abcdef"
    tables.encrypted(catalog.clipboard(spark, sf_dir).select("id", "preview", "kind"), key).write.parquet(at)
    return tables.decrypted(spark.read.parquet(at), key, "preview string, kind string")


@query(f"WITH {CLIPS} SELECT id, 'upsert' AS change FROM clips WHERE kind = 'url' OR id LIKE '%-1' UNION ALL SELECT id, 'delete' FROM clips WHERE kind = 'image' AND id NOT LIKE '%-1'")
def history_difference(spark, sf_dir):
    """One history turned into the other: links have new titles, pictures are gone, first answers are new."""
    h = catalog.clipboard(spark, sf_dir).select("id", "preview", "kind", F.coalesce("title", F.lit("")).alias("title"))
    first = F.col("id").endswith("-1")
    old = h.filter(~first)
    new = h.filter(first | (F.col("kind") != "image")).withColumn("title", F.when(F.col("kind") == "url", F.concat("title", F.lit("*"))).otherwise(F.col("title")))
    up, gone = tables.changed_rows(old, new)
    return up.select("id", F.lit("upsert").alias("change")).unionByName(gone.select("id", F.lit("delete").alias("change")))


@query(f"WITH {CLIPS} SELECT id, preview || CASE WHEN kind = 'url' THEN '*' ELSE '' END AS preview, kind FROM clips WHERE kind <> 'image'")
def history_store(spark, sf_dir):
    """A history saved, changed, saved again and loaded."""
    h = catalog.clipboard(spark, sf_dir).select("id", "preview", "kind")
    store = tables.EncryptedStore(spark, shared.fresh(spark, "history"), "0123456789abcdef", "preview string, kind string")
    store.save(h)
    store.save(h.filter("kind != 'image'").withColumn("preview", F.when(F.col("kind") == "url", F.concat("preview", F.lit("*"))).otherwise(F.col("preview"))))
    return store.load()


def _capitals(image: bytes) -> str:
    return image.decode().translate({k: k - 32 for k in range(97, 123)})


@query("""WITH c AS (SELECT conv_id || '-' || turn AS id, turn, translate(role || ' ' || conv_id, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seen FROM conversations)
SELECT id, CASE turn % 3 WHEN 0 THEN seen WHEN 1 THEN 'old' END AS ocr, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 END::INT AS ocr_revision FROM c WHERE NOT (turn % 3 = 0 AND regexp_matches(seen, 'USER 1'))""")
def images_recognised(spark, sf_dir):
    """Images read by a plug-in; some were read before, and a pattern deletes what it finds."""
    c = _table(spark, sf_dir, "conversations")
    third = F.col("turn") % 3
    rows = c.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.when(third != 2, F.encode(F.concat("role", F.lit(" "), "conv_id"), "UTF-8")).alias("image"),
        F.when(third == 1, "old").alias("ocr"), F.when(third == 1, 2).cast("int").alias("ocr_revision"),
    )
    return clipboard.recognised(rows, _capitals, 2, ("USER 1",)).select("id", "ocr", "ocr_revision")


# ---------------------------------------------------------------- clipboard and texts

@query(f"WITH {CLIPS} SELECT id FROM clips WHERE pinned OR created_at < epoch(timestamp '2024-01-01 02:00:00')")
def clipboard_cleared(spark, sf_dir):
    from datetime import datetime

    return clipboard.cleared_since(catalog.clipboard(spark, sf_dir), datetime(2024, 1, 1, 2)).select("id")


_STAMP = "timestamp '2024-01-01' + to_seconds(conv_id * 7919 + turn)"


@query(rf"""WITH t AS (SELECT conv_id, turn, role, {_STAMP} AS now, turn % 4 AS kind FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 0 THEN 'Hi ' || role || ', ' || strftime(now, '%Y-%m-%d') || ' {{other}}' WHEN 1 THEN strftime(now, '%d.%m.%Y') || '|' || strftime(now, '%H:%M') WHEN 2 THEN 'ab' || role ELSE '{{x' || conv_id || '}} {{' END AS text,
 CASE kind WHEN 2 THEN 1 WHEN 1 THEN 11 END::INT AS cursor FROM t""".replace("{{other}}", "{other}").replace("'{{x'", "'{x'").replace("'}} {{'", "'} {'"))
def snippet_templates(spark, sf_dir):
    """A column of templates: dates, the clipboard, the last cursor, unknown tokens and stray braces."""
    c = _table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    template = (
        F.when(kind == 0, "Hi {clipboard}, {{date}} {other}").when(kind == 1, "{date:dd.MM.yyyy}|{cursor}{time}").when(kind == 2, "{cursor}a{{ cursor }}b{clipboard}").otherwise(F.concat(F.lit("{x"), F.col("conv_id"), F.lit("} {")))
    )
    now = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 7919 + F.col("turn"))
    r = text.rendered_rows(template, now, F.col("role"), F.lit("u"))
    return c.select("conv_id", "turn", r["text"].alias("text"), r["cursor"].alias("cursor"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE role || '/' || conv_id END AS text, least(turn, 3)::INT AS pasted, (3 - least(turn, 3))::INT AS remaining FROM conversations""")
def entry_texts(spark, sf_dir):
    """The plain text of entries by what they hold, and how far stacks of three are pasted."""
    c = _table(spark, sf_dir, "conversations")
    address = F.concat("role", F.lit("/"), "conv_id")
    wide = F.encode("role", "UTF-16")
    item = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("public.utf16-plain-text"), wide)).otherwise(F.create_map(F.lit("public.url"), F.encode(address, "UTF-8")))
    stack = clipboard.stack_progress(F.array(*map(F.lit, "abc")), F.col("turn").cast("int"))
    return c.select("conv_id", "turn", clipboard.plain_text(item).alias("text"), stack["pasted"].alias("pasted"), stack["remaining"].alias("remaining"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'file' WHEN 'signup' THEN 'richText' WHEN 'purchase' THEN 'text' ELSE 'other' END AS category FROM events""")
def storage_categories(spark, sf_dir):
    kinds = {"view": "public.tiff", "click": "public.file-url", "signup": "public.html", "purchase": "public.utf8-plain-text"}
    kind = F.lit("com.example.unknown")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    return _table(spark, sf_dir, "events").select("event_id", clipboard.storage_category(kind).alias("category"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'trim,upper,lower,quote,json.minify,json.pretty,url.encode,base64.encode' WHEN 'click' THEN 'trim,upper,lower,quote,url.encode,url.decode,base64.encode' ELSE 'trim,upper,lower,quote,url.encode,base64.encode' END AS names FROM events""")
def applicable_transforms(spark, sf_dir):
    s = F.when(F.col("event_type") == "view", F.col("props")).when(F.col("event_type") == "click", F.concat(F.lit("a%20b "), "event_id")).otherwise(F.concat(F.lit("plain words, "), "event_type"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(text.applicable(s), ",").alias("names"))


@query("SELECT event_id, epoch(timestamp '2001-01-01') + event_id * 3600.5 AS at FROM events")
def reference_times(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", text.reference_time(F.col("event_id") * 3600.5).cast("double").alias("at"))


# ---------------------------------------------------------------- search language

# A comparison after a filter's name, and a literal with wildcards in quotation marks.
_search("comparison_value", "<size:>40k|size:<=10k> ring", "(NOT is_dir AND (size > 40960 OR size <= 10240)) AND contains(lower(name), 'ring')", "ring")
_search("quoted_literal", '"*"|"doc-1?"', "contains(name, '*') OR contains(lower(name), 'doc-1?')", "doc-1?", source="files")

_WORDS = ["ring", "a b", "\"x", "<a", "a>", "a|", "!", "size:what", "size:>5k", "", "dm:2024-13-01", "(a|b) c", "regex:(", "ext:md;txt", "(a"]


@query(f"""SELECT event_id, w AS words, w NOT IN ('"x', '<a', 'a|', '!', 'size:what', 'dm:2024-13-01', '(a', 'regex:(') AS valid
FROM (SELECT event_id, ({_WORDS!r})[event_id % {len(_WORDS)} + 1] AS w FROM events)""")
def query_validity(spark, sf_dir):
    """Which searches of a log of searches are valid. Each different text is parsed once, on the driver: they are what users typed."""
    typed = _table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS)).cast("int")).alias("words"))
    return typed.join(F.broadcast(spark.createDataFrame([(w, _valid(w)) for w in _WORDS], "words string, valid boolean")), "words")


def _valid(words: str) -> bool:
    try:
        compiled(q.parse(words), Options(now=NOW))
    except q.QueryError:
        return False
    return True


@query("SELECT event_id FROM events WHERE event_id = 0 OR event_id > 100")
def events_after_baseline(spark, sf_dir):
    """The stream of change events after a fresh build."""
    e = catalog.change_events(spark, sf_dir).select("event_id", "path", "flags", F.col("ts").alias("received_at"))
    stream = changes.events(spark, landed(e, "event_id", 2), 100)
    table = shared.fresh(spark, "stream")
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", shared.fresh(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.EVENT).parquet(table).select("event_id")


@query(f"WITH {FILES} SELECT node_id, path, CASE WHEN node_id % 3 = 0 THEN size * 2 ELSE size END::BIGINT AS size FROM files WHERE node_id % 3 = 0 OR starts_with(path, '/corpus/src2/')")
def preserved_rows(spark, sf_dir):
    """Rows with their metadata, and below folders that aren't done yet what was there before."""
    f = catalog.files(spark, sf_dir).select("node_id", "path", "size")
    return tree.preserved_union(f.filter("node_id % 3 = 0").withColumn("size", (F.col("size") * 2).cast("long")), f, spark.createDataFrame([("/corpus/src2",)], "path string"))


@query("""SELECT conv_id, turn, turn % 3 = 0 AS han FROM conversations""")
def han_names(spark, sf_dir):
    from sparklode.functions.pinyin import HAN

    name = F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit("报告"))).otherwise(F.concat("role", F.lit("é한")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.rlike(name, F.lit(HAN)).alias("han"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 AND turn % 2 = 0")
def pinyin_names(spark, sf_dir):
    """Latin letters that are the initials of a Chinese name."""
    name = F.when(F.col("turn") % 2 == 0, "年度报告.txt").otherwise("总结.txt")
    c = _table(spark, sf_dir, "conversations").filter("turn % 3 = 0")
    rows = c.select("conv_id", "turn", name.alias("name"), F.concat(F.lit("/r/"), name).alias("path"), *(F.lit(False).alias(x) for x in ("is_dir", "hidden", "in_package")))
    return search.name_matches(rows, "bg", Options(now=NOW)).select("conv_id", "turn")


# ---------------------------------------------------------------- rules, settings, upkeep

_ODD_RULES = """kinds AS (SELECT event_id, event_id % 9 AS k, CASE WHEN value < 12 THEN value ELSE value * 10 END AS n, user_id % 4 AS u, event_type AS t FROM events)"""


@query(f"""WITH {_ODD_RULES} SELECT event_id AS trigger_id FROM kinds WHERE CASE k WHEN 0 THEN NOT n > 0 WHEN 1 THEN NOT n BETWEEN 0 AND 100 WHEN 2 THEN u = 0 WHEN 3 THEN u = 0 OR u = 1
 WHEN 4 THEN u = 0 OR n > 1439 WHEN 5 THEN u IN (0, 1) WHEN 6 THEN u = 0 WHEN 7 THEN u = 0 ELSE true END""")
def invalid_rules(spark, sf_dir):
    """Rules of one criterion each: thresholds, identifiers with blanks and control characters, weekdays, ranges of two families, a kind twice."""
    e = _table(spark, sf_dir, "events").withColumns({"k": F.col("event_id") % 9, "n": F.when(F.col("value") < 12, F.col("value")).otherwise(F.col("value") * 10), "u": F.col("user_id") % 4})
    kinds = ("idle", "cpu", "wifi", "app", "schedule", "ip", "power", "displays", "unknown")
    array = lambda *values: F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values))
    texts = (
        F.when(F.col("k") == 2, F.when(F.col("u") == 0, array("x" * 33)).otherwise(array("net", "x" * 32)))
        .when(F.col("k") == 3, F.when(F.col("u") == 0, array(" \t ")).when(F.col("u") == 1, array("a\u0007b")).otherwise(array("com.example")))
        .when(F.col("k") == 4, F.when(F.col("u") == 0, array("8")).otherwise(array("1", "7")))
        .when(F.col("k") == 5, F.when(F.col("u") == 0, array("10.0.0.1", "::1")).when(F.col("u") == 1, array("10.0.0.9", "10.0.0.1")).otherwise(array("10.0.0.1", "10.0.0.1")))
    )
    rows = e.select(
        F.col("event_id").alias("trigger_id"), F.get(F.array(*map(F.lit, kinds)), F.col("k").cast("int")).alias("kind"), F.lit("=").alias("op"),
        F.when(F.col("k") == 7, F.when(F.col("u") == 0, -1.0).otherwise(0.0)).otherwise(F.col("n")).alias("number"), F.lit(60.0).alias("number2"), F.lit(None).cast("string").alias("text"), texts.alias("texts"),
        F.when((F.col("k") != 6) | (F.col("u") != 0), F.lit(True)).alias("flag"),
    )
    return rules.invalid(rows)


@query(f"""WITH {EVENTS} SELECT event_id // 50 AS batch, CASE WHEN bool_or(flags = 256 + 131072 AND event_id % 3 = 0) THEN 'quiet' WHEN bool_or(contains(path[strrpos(path, '/') + 1:], '9') OR (flags <> 6 AND contains('n' || event_id, '9'))) THEN 'immediate' ELSE 'none' END AS refresh FROM fs GROUP BY 1""".replace("path[strrpos(path, '/') + 1:]", "regexp_extract(path, '[^/]*$')"))
def live_refreshes(spark, sf_dir):
    """Which batches of changes a live search for a plain word must react to."""
    e = catalog.change_events(spark, sf_dir)
    observed = e.select(
        F.floor(F.col("event_id") / 50).alias("batch"), "path", F.when(F.col("flags") != 6, F.concat(F.lit("n"), "event_id")).alias("name"),
        ((F.col("flags") == 256 + 131072) & (F.col("event_id") % 3 == 0)).alias("subtree"),
    )
    return changes.refreshes(observed, " 9 ", Options(now=NOW))


@query("""WITH t AS (SELECT event_id, user_id, ts, value * 10 AS idle_s, event_type = 'error' AS locked FROM events),
p AS (SELECT *, sum((NOT locked AND idle_s < 100)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS period FROM t)
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS n FROM p WHERE idle_s >= 100) WHERE n = 1""")
def screen_locks(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") * 10).alias("idle_s"), (F.col("event_type") == "error").alias("locked"))
    return sessions.screen_locks(e, 100, "user_id").select("event_id")


@query(f"""WITH {CLIPS}, p AS (SELECT id, created_at, CASE WHEN conv_key % 3 = 0 THEN substr('bcdxyz', (conv_key % 6 + 1)::INT, 1) END AS pin_key FROM (SELECT id, created_at, split_part(id, '-', 1)::INT AS conv_key, pinned FROM clips) WHERE pinned),
k AS (SELECT *, row_number() OVER (PARTITION BY pin_key ORDER BY created_at, id) AS n FROM p WHERE contains('bcdefghijklmnoprstu', pin_key)),
kept AS (SELECT id, pin_key FROM k WHERE n = 1), free AS (SELECT key, row_number() OVER (ORDER BY place) AS r FROM (SELECT unnest(string_split('bcdefghijklmnoprstu', '')) AS key, unnest(range(19)) AS place) WHERE key NOT IN (SELECT pin_key FROM kept)),
rest AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS r FROM p WHERE id NOT IN (SELECT id FROM kept))
SELECT p.id, coalesce(kept.pin_key, free.key) AS pin_key FROM p LEFT JOIN kept USING (id) LEFT JOIN rest USING (id) LEFT JOIN free ON free.r = rest.r""")
def pins_repaired(spark, sf_dir):
    conv = F.split_part("id", F.lit("-"), F.lit(1)).cast("int")
    key = F.when(conv % 3 == 0, F.substring(F.lit("bcdxyz"), (conv % 6 + 1).cast("int"), F.lit(1)))
    h = catalog.clipboard(spark, sf_dir).select("id", "created_at", "pinned").withColumn("pin_key", key)
    return sessions.repaired_pins(h, clipboard.PIN_KEYS).select("id", "pin_key")


@query("SELECT user_id::VARCHAR AS path, count(*) AS open_count, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def usage_store(spark, sf_dir):
    """The usage history, written and read again."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    at = shared.fresh(spark, "usage")
    tables.save_usage(usage.tallied(e), at)
    return tables.load_usage(spark, at).select("path", "open_count", F.unix_micros("last_opened").alias("last_us"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(left(text, 400), '.'), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '' AND length(v) <= 60 AND NOT regexp_matches(v, '[\\p{Cc}\\p{Cf}]'))))[1:4], '|') AS names,
 len(list_filter(string_split(role, 's'), lambda x: NOT list_contains(['u', 'er', 'a', '', 'i', 'tant'], x))) = 0 AS known, least(2000000, greatest(1048576, 3 * strlen(text) * 1000))::BIGINT AS bytes FROM conversations""")
def settings_normalized(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    names = text.normalized_strings(F.split(F.left("text", F.lit(400)), r"\."), 4, 60)
    known = text.subset(F.split("role", "s"), F.array(*map(F.lit, ("u", "er", "a", "", "i", "tant"))))
    return c.select("conv_id", "turn", F.array_join(names, "|").alias("names"), known.alias("known"), text.search_memory(F.octet_length("text") * F.lit(1000).cast("long"), 2_000_000).alias("bytes"))
