"""Queries of the live index and of other streams: each lands the given tables as files and runs with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import paths, text
from sparklode.queries import EVENTS, query
from sparklode.queries_columns import QUERIES, SQL
from sparklode.sources import catalog, shared, tree_source
from sparklode.streaming import changes, overlays, sessions

__all__ = ["QUERIES", "SQL"]


def landed(rows: DataFrame, by: str, files: int = 3) -> str:
    """A folder with ``rows`` in a few files, by ranges of a column."""
    at = shared.fresh(rows.sparkSession, "landing")
    rows.repartitionByRange(files, by).write.parquet(at)
    return at


# ---------------------------------------------------------------- live index

def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events; those of folders name the folder."""
    e = catalog.change_events(spark, sf_dir)
    folder = F.col("flags").bitwiseAND(F.lit(text.IS_FOLDER)) != 0
    return e.select("event_id", F.when(folder, paths.parent(F.col("path"))).otherwise(F.col("path")).alias("path"), "flags", F.col("ts").alias("received_at"))


def _disk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(what the base knows, what is there now): of five files one is gone, one has a new one beside it, and all have another size."""
    base = catalog.change_events(spark, sf_dir).select("path").distinct().withColumn("size", F.lit(1).cast("long"))
    kind = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 5
    there = base.withColumn("size", F.lit(2).cast("long"))
    beside = there.filter(kind == 1).withColumn("path", F.concat("path", F.lit("~")))
    return base, there.filter(kind != 0).unionByName(beside)


def _look(disk: DataFrame) -> overlays.Look:
    """Folders of every seventh user can't be read."""
    user = lambda p: F.regexp_extract(p, "^/vol/u[0-9]+/d([0-9]+)", 1)
    closed = lambda p: F.when(user(p) != "", user(p).cast("int") % 7 == 0).otherwise(F.lit(False))
    folders = disk.select(paths.parent(F.col("path")).alias("path")).distinct().filter(closed(F.col("path")))

    def look(work: DataFrame) -> tuple[DataFrame, DataFrame]:
        deep, single = work.filter("kind = 'subtree'").select(F.col("path").alias("root")), work.filter("kind = 'exact'").select("path")
        below = disk.filter(~closed(F.col("path"))).select("*", F.explode(paths.ancestors(F.col("path"))).alias("root")).join(deep, "root")
        here = single.join(disk.withColumn("present", F.lit(True)), "path", "left").withColumns({"present": F.coalesce("present", F.lit(False)), "is_complete": ~closed(F.col("path")), "root": F.col("path")})
        found = below.withColumns({"present": F.lit(True), "is_complete": F.lit(True)}).unionByName(here)
        inside = folders.select(F.col("path").alias("hole"), F.explode(paths.ancestors(F.col("path"))).alias("root")).join(deep, "root").select("root", "hole")
        return found, inside.union(deep.filter(closed(F.col("root"))).select("root", F.col("root").alias("hole"))).distinct()

    return look


_LIVE = f"""{EVENTS}, f AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([0-9]+)$', 1)::INT % 5 AS kind, regexp_extract(path, '/d([0-9]+)/', 1)::INT % 7 = 0 AS closed FROM fs),
scanned AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM fs WHERE flags = 256 + 131072),
looked AS (SELECT DISTINCT path FROM fs WHERE flags & 65536 <> 0 OR flags = 6),
known AS (SELECT *, NOT closed AND (folder IN (SELECT folder FROM scanned) OR path IN (SELECT path FROM looked)) AS new FROM f)"""


@query(f"""WITH {_LIVE} SELECT path, CASE WHEN new THEN 2 ELSE 1 END::BIGINT AS size FROM known WHERE NOT new OR kind <> 0
UNION ALL SELECT path || '~', 2 FROM known WHERE NOT closed AND kind = 1 AND folder IN (SELECT folder FROM scanned)""")
def overlay_stream(spark, sf_dir):
    """A live index after all changes: scans of folders, single files, holes where nothing could be listed, and compaction on the way."""
    base, disk = _disk(spark, sf_dir)
    index = overlays.LiveIndex(spark, shared.fresh(spark, "live"))
    index.create(base, 16)
    stream = changes.events(spark, landed(_changes(spark, sf_dir), "event_id"), 0, 1)
    index.maintain(stream, shared.fresh(spark, "checkpoint"), _look(shared.kept(disk)), {"availableNow": True}, exact_most=2_000).awaitTermination()
    return index.visible()


# Events up to three quarters of the last are reconciled, but for paths whose events were lost.
@query(f"""WITH {EVENTS}, last AS (SELECT (max(event_id) * 3) // 4 AS n FROM fs), f AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM fs),
open_files AS (SELECT path FROM fs, last WHERE flags & 65536 <> 0 AND event_id > n OR flags = 6),
open_folders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder FROM fs, last WHERE flags = 256 + 131072 AND event_id > n)
SELECT path, path NOT IN (SELECT path FROM open_files) AND folder NOT IN (SELECT folder FROM open_folders) AS fresh FROM f""")
def index_freshness(spark, sf_dir):
    asked = changes.asked(_changes(spark, sf_dir))
    last = asked.agg(F.max("event_id")).head()[0] or 0
    reconciled = last * 3 // 4
    lost = asked.filter((F.col("kind") == "rescan") & (F.col("event_id") <= reconciled)).select("path").distinct()
    return overlays.freshness(catalog.change_events(spark, sf_dir).select("path").distinct(), asked, reconciled, lost)


@query(f"""WITH {EVENTS}, f AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, min(event_id) AS indexed FROM fs GROUP BY ALL),
one AS (SELECT path, max(event_id) AS last FROM fs WHERE flags & 131072 = 0 GROUP BY path),
deep AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, max(event_id) AS last FROM fs WHERE flags = 256 + 131072 GROUP BY 1)
SELECT path, indexed FROM f LEFT JOIN one USING (path) LEFT JOIN deep USING (folder) WHERE greatest(coalesce(one.last, -1), coalesce(deep.last, -1)) <= indexed""")
def content_kept(spark, sf_dir):
    meta = catalog.change_events(spark, sf_dir).groupBy("path").agg(F.min("event_id").alias("indexed"))
    return overlays.content_kept(meta, changes.asked(_changes(spark, sf_dir)))


# ---------------------------------------------------------------- sessions and captures

def landed_in_turn(rows: DataFrame, by: str, files: int = 3) -> str:
    """A folder with ``rows`` in a few files, one after the other in the order of a time."""
    at = shared.fresh(rows.sparkSession, "landing")
    seconds = F.col(by).cast("double")
    low, high = rows.agg(F.min(seconds), F.max(seconds)).head()
    step = ((high or 0) - (low or 0)) / files or 1.0
    part = F.least(F.floor((seconds - F.lit(low or 0.0)) / step), F.lit(files - 1))
    for k in range(files):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(at)
    return at


_COMMANDS = """cmd AS (
  SELECT user_id::VARCHAR AS owner, date_trunc('millisecond', ts) AS ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'extend' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'end' ELSE 'enable' END ELSE 'match' END AS kind,
         CASE WHEN event_type IN ('signup') THEN 'm' || event_id WHEN event_type IN ('view', 'click') AND event_id % 4 <> 0 THEN 'r' || (event_id % 3) END AS id,
         CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 5 <> 0 THEN 7200 * (1 + event_id % 40) END WHEN 'purchase' THEN 3600 END AS seconds FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS k FROM cmd),"""


@query(f"""WITH RECURSIVE {_COMMANDS}
fold AS (
  SELECT owner, 0::BIGINT AS k, NULL::TIMESTAMP AS stamp, NULL::VARCHAR AS source, NULL::VARCHAR AS id, NULL::TIMESTAMP AS deadline, true AS rules, NULL::TIMESTAMP AS due, NULL::VARCHAR AS due_source, NULL::VARCHAR AS due_id,
         NULL::VARCHAR AS action, NULL::VARCHAR AS a_source, NULL::VARCHAR AS a_id, NULL::VARCHAR AS reason FROM (SELECT DISTINCT owner FROM n)
  UNION ALL
  SELECT owner, k, stamp, CASE WHEN action IS NULL THEN s ELSE CASE WHEN action = 'end' THEN NULL WHEN kind = 'start' THEN 'manual' WHEN kind = 'match' THEN 'trigger' ELSE s END END,
         CASE WHEN action IS NULL THEN i ELSE CASE WHEN action = 'end' THEN NULL WHEN kind IN ('start', 'match') THEN name ELSE i END END,
         CASE WHEN action IS NULL THEN d WHEN kind = 'start' THEN stamp + to_seconds(seconds) WHEN kind = 'extend' THEN d + to_seconds(seconds) END,
         CASE WHEN kind = 'enable' THEN true WHEN kind = 'end' AND s = 'trigger' THEN false ELSE rules END, due, due_source, due_id, action,
         CASE WHEN action IS NULL THEN NULL WHEN kind = 'start' THEN 'manual' WHEN kind = 'match' AND action <> 'end' THEN 'trigger' ELSE s END,
         CASE WHEN action IS NULL THEN NULL WHEN kind IN ('start', 'match') AND action <> 'end' THEN name ELSE i END,
         CASE WHEN action = 'end' THEN CASE WHEN kind = 'end' THEN 'requested' ELSE 'condition' END END
  FROM (
    SELECT *, CASE kind WHEN 'start' THEN CASE WHEN s IS NULL THEN 'start' ELSE 'replace' END WHEN 'extend' THEN CASE WHEN d IS NOT NULL THEN 'extend' END WHEN 'end' THEN CASE WHEN s IS NOT NULL THEN 'end' END
      WHEN 'match' THEN CASE WHEN s IS NULL THEN CASE WHEN w IS NOT NULL THEN 'start' END WHEN s = 'trigger' AND w IS DISTINCT FROM i THEN CASE WHEN w IS NULL THEN 'end' ELSE 'replace' END END END AS action
    FROM (
      SELECT f.owner, n.k, n.ts AS stamp, n.kind, n.id AS name, n.seconds, f.rules, CASE WHEN f.rules THEN n.id END AS w, coalesce(f.deadline <= n.ts, false) AS over,
             CASE WHEN over THEN NULL ELSE f.source END AS s, CASE WHEN over THEN NULL ELSE f.id END AS i, CASE WHEN over THEN NULL ELSE f.deadline END AS d,
             CASE WHEN over THEN f.deadline END AS due, CASE WHEN over THEN f.source END AS due_source, CASE WHEN over THEN f.id END AS due_id
      FROM fold f JOIN n ON n.owner = f.owner AND n.k = f.k + 1))),
last AS (SELECT max(ts) AS ts FROM cmd),
open_ends AS (SELECT owner, deadline, source, id FROM fold WHERE (owner, k) IN (SELECT owner, max(k) FROM fold GROUP BY owner) AND deadline <= (SELECT ts FROM last))
SELECT owner, stamp AS ts, action, a_source AS source, a_id AS id, reason FROM fold WHERE action IS NOT NULL
UNION ALL SELECT owner, due, 'end', due_source, due_id, 'deadline' FROM fold WHERE due IS NOT NULL
UNION ALL SELECT owner, deadline, 'end', source, id, 'deadline' FROM open_ends""")
def session_stream(spark, sf_dir):
    """Sessions by hand and by rules, with deadlines, extensions and ends, as a stream with timers."""
    e = catalog.table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    is_match = kind.isin("view", "click")
    commands = e.select(
        F.col("user_id").cast("string").alias("owner"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), n.alias("seq"),
        F.when(kind == "signup", "start").when(kind == "purchase", "extend").when(kind == "error", F.when(n % 2 == 0, "end").otherwise("enable")).otherwise("match").alias("kind"),
        F.when(kind == "signup", F.concat(F.lit("m"), n)).when(is_match & (n % 4 != 0), F.concat(F.lit("r"), n % 3)).alias("id"),
        F.when(kind == "signup", F.when(n % 5 != 0, 7200 * (1 + n % 40))).when(kind == "purchase", 3600).cast("double").alias("seconds"),
    )
    return _streamed(spark, commands, sessions.COMMAND, sessions.sessions, sessions.ACTION)


def _streamed(spark: SparkSession, rows: DataFrame, schema: str, through, out: str) -> DataFrame:
    """What a stateful stream has written once all of ``rows`` went through it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed_in_turn(rows, "ts"))
    table = shared.fresh(spark, "stream")
    sessions.written(through(stream), table, shared.fresh(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return spark.read.schema(out).parquet(table)


@query("""WITH c AS (SELECT sha256(props) AS content_hash, date_trunc('millisecond', ts) AS ts FROM events),
g AS (SELECT *, coalesce(date_diff('millisecond', lag(ts) OVER w, ts) > 43200000, true) AS fresh FROM c WINDOW w AS (PARTITION BY content_hash ORDER BY ts)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY content_hash ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g),
e AS (SELECT content_hash, min(ts) AS first_at, max(ts) AS last_at, count(*) AS copies FROM r GROUP BY content_hash, run)
SELECT * FROM e WHERE last_at + INTERVAL 12 HOUR <= (SELECT max(ts) FROM c)""")
def capture_expiry_stream(spark, sf_dir):
    """Captures by content, each gone twelve hours after it was last copied."""
    e = catalog.table(spark, sf_dir, "events")
    captures = e.select(F.sha2("props", 256).alias("content_hash"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))
    return _streamed(spark, captures, "content_hash string, ts timestamp", lambda s: sessions.expired(s, 12 * 3_600_000, 64), sessions.ENTRY)


# ---------------------------------------------------------------- folders and large files

def _written(spark: SparkSession, sf_dir: str, value) -> str:
    """Documents as text files in folders by source and language; the files' names are Spark's own."""
    d = catalog.table(spark, sf_dir, "documents").select(value.alias("value"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    at = shared.fresh(spark, "tree")
    # A frequent source is dealt to several files.
    d.repartition("source", "lang", F.pmod(F.xxhash64("value"), F.lit(16))).write.partitionBy("source", "lang").text(at)
    return at


_FOLDERS = "SELECT 'source=' || coalesce(source, 'none') AS s, 'lang=' || coalesce(lang, 'none') AS l"


@query(f"""WITH d AS ({_FOLDERS}, length(doc_id::VARCHAR) + 1 AS n FROM documents)
SELECT s || '/' || l AS folder, 2 AS depth, sum(n)::BIGINT AS bytes FROM d GROUP BY ALL UNION ALL SELECT s, 1, sum(n)::BIGINT FROM d GROUP BY s""")
def tree_scan(spark, sf_dir):
    """Folder rows of a tree and the bytes of the text files below each."""
    at = _written(spark, sf_dir, F.col("doc_id").cast("string"))
    rows = tree_source.tree(spark, [at], 8)
    root = F.lit(tree_source.local_path(at))
    files = rows.filter("NOT is_dir AND NOT is_link AND name LIKE 'part-%'").select("size", F.explode(paths.ancestors(F.col("path"), False)).alias("path"))
    sizes = files.groupBy("path").agg(F.sum("size").alias("bytes"))
    folder = F.substring("path", F.length(root) + 2, F.length("path"))
    inside = rows.filter(F.col("is_dir") & F.col("listed") & (F.col("path") != root)).select("path", folder.alias("folder"))
    return inside.join(sizes, "path").select("folder", (F.size(F.split("folder", "/"))).alias("depth"), "bytes")


@query(f"""WITH d AS ({_FOLDERS}, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT s || '/' || l AS folder, sum((strlen(t) - strlen(replace(t, 'moron', ''))) // 5)::BIGINT AS n FROM d GROUP BY ALL HAVING n > 0""")
def chunked_literal(spark, sf_dir):
    """A literal in large files, read by pieces of 64 KiB."""
    at = _written(spark, sf_dir, F.coalesce("text", F.lit("")))
    found = tree_source.literal_hits(spark, at, "Moron", 1 << 16)
    return found.groupBy(F.regexp_extract("path", "(source=[^/]+/lang=[^/]+)/", 1).alias("folder")).agg(F.sum("n").alias("n"))
