"""More queries of the engine: functions of paths, texts and captures, and the work that change events ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.functions import paths, text
from sparklode.operators import clipboard, tree
from sparklode.queries import CLIP_ORDER, CLIPS, EVENTS, FILES, QUERIES, SQL, query
from sparklode.sources import catalog
from sparklode.streaming import changes

__all__ = ["QUERIES", "SQL"]


def _up(path: str) -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


def _table(spark, sf_dir, name) -> DataFrame:
    return catalog.table(spark, sf_dir, name)


# ---------------------------------------------------------------- change events

_MADE = "CASE WHEN event_type = 'view' THEN '/.docid/' || user_id || '/changed/' || event_id || '/src=' || user_id || ',dst=7' ELSE '/vol/.docid/' || user_id END"


@query(rf"SELECT event_id, regexp_full_match({_MADE}, '/+\.docid/+\d+/+changed/+\d+/+src=\d+,dst=\d+/*') AS synthetic FROM events")
def synthetic_paths(spark, sf_dir):
    made = F.concat(F.lit("/.docid/"), "user_id", F.lit("/changed/"), "event_id", F.lit("/src="), "user_id", F.lit(",dst=7"))
    path = F.when(F.col("event_type") == "view", made).otherwise(F.concat(F.lit("/vol/.docid/"), "user_id"))
    return _table(spark, sf_dir, "events").select("event_id", text.synthetic_path(path).alias("synthetic"))


# Signups and purchases name the folder; an event of lost changes names the volume's folder above it.
_BATCH = f"""{EVENTS}, e AS (SELECT event_id, flags, CASE WHEN flags & 131072 <> 0 THEN {_up('path')} ELSE path END AS path FROM fs),
k AS (SELECT path, event_id, CASE WHEN flags & 6 <> 0 THEN 3 WHEN flags & 65536 <> 0 THEN 1 WHEN flags & 256 <> 0 THEN 2 ELSE 0 END AS level FROM e),
one AS (SELECT path, max(level) AS level, max(event_id) AS event_id FROM k GROUP BY path), roots AS (SELECT path FROM one WHERE level >= 2)"""


@query(f"""WITH {_BATCH} SELECT (['metadata', 'exact', 'subtree', 'rescan'])[level + 1] AS kind, path, event_id FROM one
WHERE {_up('path')} NOT IN (SELECT path FROM roots) AND {_up(_up('path'))} NOT IN (SELECT path FROM roots)""")
def change_batch_work(spark, sf_dir):
    e = catalog.change_events(spark, sf_dir)
    folder = F.col("flags").bitwiseAND(F.lit(text.IS_FOLDER)) != 0
    return changes.batch_work(e.withColumn("path", F.when(folder, paths.parent(F.col("path"))).otherwise(F.col("path"))))


@query(f"""WITH {EVENTS}, one AS (SELECT path, min(event_id) - 1 AS first_id, max(event_id) AS last_id, max_by(flags, event_id) AS flags FROM fs GROUP BY path)
SELECT path, last_id AS event_id FROM one WHERE flags <> 6""")
def change_upserts(spark, sf_dir):
    """The base knows each path from before its first event; the last event of a path decides, and lost ones are tombstones."""
    e = catalog.change_events(spark, sf_dir)
    base = e.groupBy("path").agg((F.min("event_id") - 1).alias("event_id"))
    return changes.upserted(base, e.select("path", "event_id", (F.col("flags") != 6).alias("present")))


@query(f"""WITH {EVENTS}, failed AS (SELECT DISTINCT path FROM fs WHERE flags = 6), before AS (SELECT path, count(*) AS tries FROM fs WHERE flags <> 6 GROUP BY path)
SELECT path, (coalesce(tries, 0) + 1)::BIGINT AS tries, least(300, 5 * 2 ** least(coalesce(tries, 0), 6))::INT AS wait FROM failed LEFT JOIN before USING (path)""")
def change_retries(spark, sf_dir):
    e = catalog.change_events(spark, sf_dir)
    return changes.retries(e.filter("flags = 6"), e.filter("flags != 6").groupBy("path").agg(F.count("*").alias("tries")))


@query(f"""WITH {EVENTS}, later AS (SELECT event_id AS rev, path FROM fs WHERE event_id > 100)
SELECT rev, path FROM later WHERE (SELECT count(DISTINCT rev) = max(rev) - 100 FROM later)""")
def contiguous_revisions(spark, sf_dir):
    return tree.contiguous_changes(catalog.change_events(spark, sf_dir).select(F.col("event_id").alias("rev"), "path"), 100)


@query(f"WITH {EVENTS} SELECT path, min(event_id) AS node_id FROM fs GROUP BY path")
def first_of_path(spark, sf_dir):
    return tree.first_by_path(catalog.change_events(spark, sf_dir).select("path", F.col("event_id").alias("node_id")))


# ---------------------------------------------------------------- paths

@query(f"""WITH {FILES} SELECT node_id FROM files WHERE starts_with(path, '/corpus/src4/') OR path = '/corpus/src1/en/doc-1.md' OR starts_with(path, '/corpus/src2/fr/')""")
def overlapping_paths(spark, sf_dir):
    return tree.overlapping(catalog.files(spark, sf_dir), ["/corpus/src4", "/corpus/src1/en/doc-1.md", "/corpus/src2/fr/"]).select("node_id")


@query(f"WITH {FILES} SELECT node_id, (CASE WHEN size * 3 >= 4096 THEN size * 3 ELSE size END)::BIGINT AS size FROM files")
def package_sizes(spark, sf_dir):
    f = catalog.files(spark, sf_dir)
    sized = tree.package_sizes(f, f.select("path", (F.col("size") * 3).alias("bytes")))
    return sized.select("node_id", F.col("size").cast("long").alias("size"))


_ODD = "(['/.nofollow/vol/', '/System/Volumes/Data/Users/', '/System/Volumes/Database/', '/private/tmp/', '/private/tmpx/'])[user_id % 5 + 1] || event_type"


@query(rf"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace({_ODD}, '^/\.nofollow(/)', '\1'),
 '^/System/Volumes/Data(/(Applications|Library|Users|Volumes|opt|private|usr|cores|home)(/|$))', '\1'), '^/private(/(var|tmp|etc)(/|$))', '\1') AS path FROM events""")
def canonical_paths(spark, sf_dir):
    starts = F.array(*map(F.lit, ("/.nofollow/vol/", "/System/Volumes/Data/Users/", "/System/Volumes/Database/", "/private/tmp/", "/private/tmpx/")))
    path = F.concat(F.get(starts, F.col("user_id") % 5), "event_type")
    return _table(spark, sf_dir, "events").select("event_id", paths.canonical(path).alias("path"))


_KINDS = "'/vol/' || (['.git/a', 'Tool.APP/in/a', 'a/../b', 'My.app', 'talk.key/a.txt'])[user_id % 5 + 1]"


@query(f"""SELECT event_id, regexp_matches(p, '(^|/)\\.([^./]|\\.[^/])[^/]*') AS hidden, regexp_matches(lower(p), '[^/]\\.(app|key)/') AS inside FROM (SELECT event_id, {_KINDS} AS p FROM events)""")
def path_visibility(spark, sf_dir):
    ends = F.array(*map(F.lit, (".git/a", "Tool.APP/in/a", "a/../b", "My.app", "talk.key/a.txt")))
    path = F.concat(F.lit("/vol/"), F.get(ends, F.col("user_id") % 5))
    return _table(spark, sf_dir, "events").select("event_id", paths.is_hidden(path).alias("hidden"), paths.in_package(path).alias("inside"))


# ---------------------------------------------------------------- clipboard

def _fuzzy_sql(letters: str) -> str:
    """A step a letter: how far it is to its next place, and what it adds."""
    steps = ["f0 AS (SELECT id, pinned, created_at, left(lower(searchable), 10000) AS low, 0 AS spot, 0 AS score FROM seen)"]
    for k, c in enumerate(letters):
        gain = "CASE WHEN hop = 1 THEN 4 ELSE 1 END" if k else "CASE WHEN hop = 1 THEN 5 ELSE 2 END"
        hops = f"SELECT *, strpos(substr(low, spot + 1), '{c}') AS hop FROM f{k}"
        steps.append(f"f{k + 1} AS (SELECT id, pinned, created_at, low, spot + hop AS spot, score + {gain} AS score FROM ({hops}) WHERE hop > 0)")
    order = "ORDER BY CASE WHEN pinned THEN 0 ELSE 1 END, score DESC, created_at DESC, upper(id)"
    return f"WITH {CLIPS}, {', '.join(steps)} SELECT row_number() OVER ({order})::INT AS position, id, score::INT AS score FROM f{len(letters)}"


SQL["clipboard_fuzzy"] = _fuzzy_sql("tl2w")


@query(f"WITH {CLIPS}, p AS (SELECT id, row_number() OVER ({CLIP_ORDER}) AS position FROM clips) SELECT id, (41 - position)::INT AS pos FROM p WHERE position BETWEEN 12 AND 40")
def clipboard_range(spark, sf_dir):
    every = clipboard.search(catalog.clipboard(spark, sf_dir), "")
    return clipboard.between(every, 40, 12).select("id", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {CLIPS} SELECT c.id, (-created_at)::BIGINT AS pos FROM clips c WHERE kind = 'url'")
def clipboard_selected(spark, sf_dir):
    h = catalog.clipboard(spark, sf_dir)
    c = _table(spark, sf_dir, "conversations")
    gone = c.select(F.concat(F.lit("gone-"), "conv_id").alias("id"), F.lit(0).cast("long").alias("pos"))
    pick = h.filter("kind = 'url'").select("id", (-F.unix_timestamp("created_at")).alias("pos"))
    return clipboard.selected(h, pick.union(gone)).select("id", "pos")


@query("""SELECT conv_id || '-' || turn AS id FROM conversations
WHERE role <> 'system' AND length(text) % 3 <> 1 AND NOT regexp_matches(left(text, 100000), '(?i)pass(word|port)|[0-9]{4}')""")
def captures_admitted(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    types = F.when(F.length("text") % 3 == 1, F.array(F.lit("public.text"), F.lit("org.concealed"))).otherwise(F.array(F.lit("public.text")))
    captures = c.select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.col("role").alias("app"), types.alias("types"), "text")
    return clipboard.admitted(captures, ["system"], [], ["org.concealed"], ["(?i)pass(word|port)", "[0-9]{4}"]).select("id")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'url' WHEN 'signup' THEN 'richText' WHEN 'purchase' THEN 'text' ELSE 'other' END AS kind FROM events""")
def capture_kinds(spark, sf_dir):
    kinds = {"view": "public.utf8-plain-text public.file-url", "click": "public.url public.html", "signup": "public.utf8-plain-text public.rtf", "purchase": "public.png public.utf8-plain-text"}
    types: Column = F.array(F.lit("unknown"))
    for k, v in kinds.items():
        types = F.when(F.col("event_type") == k, F.split(F.lit(v), " ")).otherwise(types)
    return _table(spark, sf_dir, "events").withColumn("types", types).select("event_id", clipboard.presentation().alias("kind"))


def _items(c: DataFrame) -> DataFrame:
    raw = lambda name: F.encode(name, "UTF-8")
    return c.withColumn("items", F.array(F.create_map(F.lit("a"), raw("text")), F.create_map(F.lit("a"), raw("role"), F.lit("b"), raw("role"))))


@query("SELECT sum(strlen(text) + 2 * strlen(role))::BIGINT AS bytes FROM conversations")
def clip_payloads(spark, sf_dir):
    return clipboard.payload_bytes(_items(_table(spark, sf_dir, "conversations")))


@query("SELECT conv_id, turn, text AS a, role AS b FROM conversations")
def first_item_values(spark, sf_dir):
    first = clipboard.first_values(F.col("items"))
    return _items(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", *(first[k].cast("string").alias(k) for k in "ab"))


@query(f"WITH {CLIPS} SELECT lower(keyword) AS keyword, count(*) AS n FROM clips WHERE keyword IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_keywords(spark, sf_dir):
    return clipboard.repeated_keywords(catalog.clipboard(spark, sf_dir))


@query("""WITH k AS (SELECT DISTINCT substr('bcdefghijklm', (conv_id % 12 + 1)::INT, 1) AS key FROM conversations)
SELECT string_agg(key, '' ORDER BY key) AS free FROM (SELECT unnest(string_split('bcdefghijklmnoprstu', '')) AS key) WHERE key NOT IN (SELECT key FROM k)""")
def free_pin_keys(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.substring(F.lit("bcdefghijklm"), (F.col("conv_id") % 12 + 1).cast("int"), F.lit(1)).alias("pin_key"))
    return clipboard.free_pin_keys(c).select(F.array_join(F.array_sort("free"), "").alias("free"))


@query("""WITH c AS (SELECT conv_id || '-' || turn AS id, conv_id * 10 + turn AS n, role FROM conversations)
SELECT id, row_number() OVER (ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, CASE WHEN role <> 'system' THEN n END, n DESC, id)::INT AS position FROM c""")
def deletion_undone(spark, sf_dir):
    """Answers were removed, and what the system says was added since."""
    c = _table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), (F.col("conv_id") * 10 + F.col("turn")).alias("created_at"), "role")
    c = c.withColumn("pos", F.when(F.col("role") != "system", F.col("created_at")))
    back = clipboard.undone(c.filter("role != 'assistant'"), c.filter("role = 'assistant'"))
    return back.select("id", F.col("position").cast("int").alias("position"))


@query("""WITH t AS (SELECT conv_id, turn, string_split(lower(text), 'er') AS parts FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(range(1, len(parts)), lambda i: length(array_to_string(parts[1:i], 'er')) + 1), ',') AS starts FROM t""")
def match_ranges(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(clipboard.ranges(F.col("text"), "er"), ",").alias("starts"))


# ---------------------------------------------------------------- texts

@query(r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line,
 CASE WHEN trim(text) <> '' AND NOT regexp_matches(trim(text), '[\p{Cc}\p{Cf}]') THEN left(trim(text), 40) END AS named,
 CASE WHEN regexp_full_match(role || (['', '-x', ' y'])[turn % 3 + 1], '[A-Za-z0-9][A-Za-z0-9.-]{0,254}') THEN role || (['', '-x', ' y'])[turn % 3 + 1] END AS bundle FROM conversations""")
def text_cleanups(spark, sf_dir):
    role = F.concat("role", F.get(F.array(F.lit(""), F.lit("-x"), F.lit(" y")), F.col("turn") % 3))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.collapsed(F.col("text")).alias("one_line"), text.metadata_text(F.col("text"), 40).alias("named"), text.bundle_id(role).alias("bundle"))


_SPACED = "repeat(' ', (conv_id % 3)::INT) || role || chr(9) || turn || chr(10) || role || repeat(' ', (turn % 4)::INT)"


@query(f"""SELECT conv_id, turn, repeat('·', (conv_id % 3)::INT) || role || '⇥' || turn || '⏎' || role || repeat('·', (turn % 4)::INT) AS shown, trim(replace({_SPACED}, chr(10), ' ')) AS plain FROM conversations""")
def visible_titles(spark, sf_dir):
    space = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    t = F.concat(space(F.col("conv_id") % 3), "role", F.lit("\t"), "turn", F.lit("\n"), "role", space(F.col("turn") % 4))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.visible_title(t, True).alias("shown"), text.visible_title(t, False).alias("plain"))


@query(f"""SELECT conv_id, turn, {"".join("replace(" for _ in "!$'()*,:;=@?/~&")}url_encode(text){"".join(f", '%{ord(c):02X}', '{c * 2 if c == chr(39) else c}')" for c in "!$'()*,:;=@?/~&")} AS encoded, text AS back FROM conversations""")
def url_round_trip(spark, sf_dir):
    encoded = text.url_encoded(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", encoded.alias("encoded"), text.url_decoded(encoded).alias("back"))


_HEX = "substr(sha256(props), 1, (event_id % 7 + 2)::INT)"
_PART = lambda i: f"round(('0x' || substr(f, {i}, 2))::INT / 255, 6)"


@query(f"""WITH h AS (SELECT event_id, {_HEX} AS h FROM events), g AS (SELECT event_id, CASE WHEN length(h) IN (3, 4) THEN regexp_replace(h, '(.)', '\\1\\1', 'g') WHEN length(h) IN (6, 8) THEN h END AS g FROM h),
f AS (SELECT event_id, CASE WHEN length(g) = 6 THEN g || 'ff' ELSE g END AS f FROM g) SELECT event_id, {_PART(1)} AS r, {_PART(3)} AS g, {_PART(5)} AS b, {_PART(7)} AS a FROM f""")
def colours(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("#"), F.substring(F.sha2("props", 256), F.lit(1), (F.col("event_id") % 7 + 2).cast("int"))).alias("h"))
    c = text.colour(F.col("h"))
    return e.select("event_id", *(F.round(c[k], 6).alias(k) for k in "rgba"))


@query("""WITH s AS (SELECT event_id, event_id * 7 - 300 AS v FROM events), c AS (SELECT event_id, greatest(v, 0)::BIGINT AS s, ((greatest(v, 0) + 59) // 60)::BIGINT AS m FROM s)
SELECT event_id, printf('%d:%02d', m // 60, m % 60) AS short, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS long FROM c""")
def durations(spark, sf_dir):
    v = F.col("event_id") * 7 - 300
    return _table(spark, sf_dir, "events").select("event_id", text.duration(v).alias("short"), text.duration(v, True).alias("long"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '4' || printf('%08x', (10 * 16777216 + (user_id % 256) * 256 + event_id % 256)::BIGINT)
 WHEN 'click' THEN '6fe80' || repeat('0', 24) || printf('%04x', (event_id % 65536)::BIGINT) WHEN 'error' THEN NULL ELSE '6' || repeat('0', 20) || 'ffff' || '0a00' || printf('%04x', (256 + event_id % 256)::BIGINT) END AS key FROM events""")
def address_keys(spark, sf_dir):
    four = F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256)
    six = F.concat(F.lit("FE80::"), F.hex(F.col("event_id") % 65536), F.lit("%en0"))
    mixed = F.concat(F.lit("::ffff:10.0.1."), F.col("event_id") % 256)
    kind = F.col("event_type")
    address = F.when(kind == "view", four).when(kind == "click", six).when(kind == "error", F.lit("10.0.1.256")).otherwise(mixed)
    return _table(spark, sf_dir, "events").select("event_id", text.ip_key(address).alias("key"))
