"""Clipboard history: structured query, search modes, order, merging, retention, snippets.

A history has id, created_at, first_copied_at, preview, kind, pinned, pin_key, title, bundle, app, ocr, copies, collection, keyword, expand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklode.operators.ranks import numbered
from sparklode.sources.shared import kept

_FILTER = re.compile(r'(?i)(?:^|\s)(app|type|is|collection):(?:"([^"]{1,256})"|([^\s"]{1,256}))')
# Words for kinds and states.
KINDS = {
    "text": "text 文本", "richText": "rich richtext rich-text 富文本", "url": "url link 链接 网址", "file": "file files 文件",
    "image": "image images 图片 图像", "other": "other 其他",
}
STATES = {"pinned": "pinned saved reusable 置顶 已保存 复用", "unpinned": "unpinned 未置顶", "snippet": "snippet 片段"}
_KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
_STATE_OF = {w: k for k, ws in STATES.items() for w in ws.split()}
FUZZY_LIMIT, PATTERN_LIMIT, QUICK = 10_000, 512, 9
# Keys that pinned rows may have.
PIN_KEYS = "bcdefghijklmnoprstu"


@dataclass(frozen=True)
class Structured:
    text: str
    filters: tuple[tuple[str, str], ...]

    def matches(self) -> Column:
        """All filters hold; words that mean nothing match nothing."""
        out = F.lit(True)
        for field, value in self.filters:
            v = value.lower()
            if field == "app":
                test = F.contains(F.lower(F.concat_ws("\n", "app", "bundle")), F.lit(v))
            elif field == "type":
                test = F.col("kind") == _KIND_OF[v] if v in _KIND_OF else F.lit(False)
            elif field == "is":
                test = {"pinned": F.col("pinned"), "unpinned": ~F.col("pinned"), "snippet": F.col("keyword").isNotNull() | F.col("expand").isNotNull()}.get(_STATE_OF.get(v), F.lit(False))
            else:
                test = F.contains(F.lower("collection"), F.lit(v))
            out = out & F.coalesce(test, F.lit(False))
        return out


def structured(query: str) -> Structured:
    query = query[:4096]
    found, parts, last = [], [], 0
    for m in _FILTER.finditer(query):
        value = (m[2] or m[3]).strip()
        if value:
            found.append((m[1].lower(), value))
            parts += [query[last : m.start()], " "]
            last = m.end()
    text = "".join([*parts, query[last:]])
    return Structured(" ".join(text.split()) if found else text.strip(), tuple(found))


def token(field: str, value: str) -> str:
    """A filter as text; quoted if it has spaces."""
    clean = value.replace('"', "").strip()
    return f'{field}:"{clean}"' if re.search(r"\s", clean) else f"{field}:{clean}"


def searchable() -> Column:
    """What a search looks at, one line each; an alias brings the text itself with it."""
    alias = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.col("preview"))
    return F.concat_ws("\n", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("preview")), alias, "app", "bundle", "ocr", "keyword", "collection")


def fuzzy_score(text: Column, query: str) -> Column:
    """Greedy subsequence match: 5 for a first letter at the start, else 2; then 4 for the next letter, else 1. NULL without a match."""
    low = F.lower(F.left(text, F.lit(FUZZY_LIMIT)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"))
    letters = F.array(*[F.lit(c) for c in query.lower()]) if query else F.array().cast("array<string>")

    def step(a: Column, c: Column) -> Column:
        at = F.when(a["at"] >= 0, F.call_function("locate", c, low, a["at"] + 1)).otherwise(0)
        gain = F.when(a["score"] == 0, F.when(at == 1, 5).otherwise(2)).otherwise(F.when(at == a["at"] + 1, 4).otherwise(1))
        return F.struct(F.when(at > 0, at).otherwise(-1).alias("at"), F.when(at > 0, a["score"] + gain).otherwise(a["score"]).alias("score"))

    end = F.aggregate(letters, start, step)
    return F.when(end["at"] >= 0, end["score"])


def ranges(text: Column, query: str) -> Column:
    """Starts (from 1) of the non-overlapping matches of a literal without regard to case."""
    low, n = F.lower(text), len(query)
    parts = F.split(low, re.escape(query.lower()))
    lengths = F.transform(parts, F.length)
    at = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x) + (i - 1) * n + 1)
    return F.slice(at, F.lit(1), F.size(parts) - 1)


def _modes(text: str) -> dict[str, Column]:
    s = searchable()
    exact = F.contains(F.lower(s), F.lit(text.lower()))
    pattern = F.lit(False)
    if len(text) <= PATTERN_LIMIT:
        try:
            re.compile(text)
            pattern = F.rlike(s, F.lit(text))
        except re.error:
            pass
    return {"exact": exact, "regex": pattern, "fuzzy": fuzzy_score(s, text).isNotNull()}


def order(pins_first: bool | None = True, by: str = "created_at") -> list[Column]:
    pin = [] if pins_first is None else [F.when(F.col("pinned"), 0 if pins_first else 1).otherwise(1 if pins_first else 0)]
    return [*pin, F.col(by).desc(), F.upper("id")]


def search(history: DataFrame, query: str, mode: str = "exact", pins_first: bool | None = True, by: str = "created_at") -> DataFrame:
    """Rows with ``position`` from 1. Modes: exact, regex (with regard to case), fuzzy, mixed (the first of these that finds any row)."""
    s = structured(query)
    rows = history.filter(s.matches())
    sort = order(pins_first, by)
    if s.text:
        tests = _modes(s.text)
        if mode == "mixed":
            tagged = rows.withColumn("_level", F.when(tests["exact"], 1).when(tests["regex"], 2).when(tests["fuzzy"], 3)).filter(F.col("_level").isNotNull())
            best = tagged.agg(F.min("_level").alias("_best"))
            rows = tagged.join(F.broadcast(best), F.col("_level") == F.col("_best")).drop("_best", "_level")  # one row
            rows = rows.withColumn("score", fuzzy_score(searchable(), s.text))
        else:
            rows = rows.filter(tests[mode])
            if mode == "fuzzy":
                rows = rows.withColumn("score", fuzzy_score(searchable(), s.text))
                sort = [*([] if pins_first is None else sort[:1]), F.col("score").desc(), F.col("created_at").desc(), F.upper("id")]
    return numbered(rows, sort, kept, "position")


def merged(copies: DataFrame) -> DataFrame:
    """(content, ts, app, ...) captures -> one row a content: first and last time, count, the last known source."""
    return copies.groupBy(F.sha2("content", 256).alias("content_hash")).agg(
        F.min("ts").alias("first_copied_at"), F.max("ts").alias("created_at"), F.count("*").alias("copies"), F.max_by("app", F.when(F.col("app").isNotNull(), F.struct("ts", "id"))).alias("app")
    )


def retained(history: DataFrame, cutoff) -> DataFrame:
    """Pinned rows, and others not older than ``cutoff`` (None: all)."""
    return history if cutoff is None else history.filter(F.col("pinned") | (F.col("created_at") >= F.lit(cutoff)))


def cleared_since(history: DataFrame, since) -> DataFrame:
    """What is left when unpinned rows from ``since`` on go."""
    return history.filter(F.col("pinned") | (F.col("created_at") < F.lit(since)))


def quick_picks(history: DataFrame, by: str = "created_at") -> DataFrame:
    """The first nine unpinned rows and their numbers."""
    top = history.filter(~F.col("pinned")).orderBy(F.desc(by), F.upper("id")).limit(QUICK)
    return top.withColumn("pick", F.row_number().over(Window.orderBy(F.desc(by), F.upper("id"))))


def recent(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.upper("id")).limit(min(max(n, 1), 50))


def selected(history: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows in the order of a selection (id, pos); ids that are gone drop out."""
    return history.join(selection, "id").orderBy("pos")


def between(positions: DataFrame, anchor: int, target: int) -> DataFrame:
    low, high = sorted((anchor, target))
    rows = positions.filter(F.col("position").between(low, high))
    return rows.withColumn("pos", F.col("position") - low + 1 if anchor <= target else F.lit(high + 1) - F.col("position"))


def joined(selection: DataFrame, separator: str = "\n", by: tuple[str, ...] = ()) -> DataFrame:
    """The texts of a selection (pos, text) as one; of several selections, if ``by`` names them."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return selection.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))


def suffix_snippets(typed: DataFrame, snippets: DataFrame) -> DataFrame:
    """(typed_id, typed) and (id, keyword) -> the longest keyword each typed text ends with, ties by the keyword.

    Joined on the length-bounded suffixes of the typed text, not by comparing all with all.
    """
    n = F.least(F.length("typed"), F.lit(64))
    ends = typed.filter(F.length("typed") > 0).select("typed_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.lower(F.expr("typed").substr(F.length("typed") - i + 1, i)))).alias("_end"))
    hits = ends.join(snippets.select("id", "keyword"), F.col("_end") == F.lower("keyword"))
    best = F.row_number().over(Window.partitionBy("typed_id").orderBy(F.length("keyword").desc(), "keyword", "id"))
    return hits.withColumn("_n", best).filter("_n = 1").select("typed_id", "id", "keyword")


def snippet_merge(history: DataFrame, records: DataFrame) -> DataFrame:
    """Import of records (id, title, preview, keyword, collection): pinned rows of the same id are updated, unpinned ones keep their place and the record gets a new id, others are added.

    A new id is the old one with the first of "-2", "-3", ... that no row and no record has: the numbers taken are looked up by the part
    of an id before them. Records whose keyword another one, or another pinned row, has as well are left out (see :func:`refused`).
    """
    records = records.join(refused(history, records).select("id"), "id", "left_anti")
    old = history.select("id", "pinned", "title", "preview", "keyword", "collection")
    new = records.select("id", *(F.col(c).alias(f"n_{c}") for c in ("title", "preview", "keyword", "collection")), F.lit(True).alias("_new"))
    both = old.join(new, "id", "full")
    update = F.coalesce("_new", F.lit(False)) & F.coalesce("pinned", F.lit(True))
    take = lambda c: F.when(update, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    kept = both.select("id", F.when(update, True).otherwise(F.col("pinned")).alias("pinned"), *(take(c) for c in ("title", "preview", "keyword", "collection")))
    clash = both.filter(F.coalesce("_new", F.lit(False)) & ~F.coalesce("pinned", F.lit(True)))
    stem, number = F.regexp_extract("id", "^(.*)-([1-9][0-9]{0,8})$", 1), F.regexp_extract("id", "^(.*)-([1-9][0-9]{0,8})$", 2)
    taken = both.filter(number != "").select(stem.alias("_stem"), number.cast("int").alias("_k")).join(clash.select(F.col("id").alias("_stem")), "_stem", "left_semi").groupBy("_stem").agg(F.collect_set("_k").alias("_taken"))
    # Of n numbers taken, one of the n + 1 from 2 on is free.
    free = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("_taken") + 2), "_taken"))
    fresh = clash.join(taken, F.col("id") == F.col("_stem"), "left").select(
        F.concat("id", F.lit("-"), F.coalesce(free, F.lit(2))).alias("id"), F.lit(True).alias("pinned"), *(F.col(f"n_{c}").alias(c) for c in ("title", "preview", "keyword", "collection"))
    )
    return kept.unionByName(fresh)


def refused(history: DataFrame, records: DataFrame) -> DataFrame:
    """(id, keyword) of records whose keyword, in any case, another record has, or a pinned row with another id."""
    word = lambda rows: rows.filter(F.col("keyword").isNotNull()).select("id", "keyword", F.lower("keyword").alias("_k"))
    new, old = word(records), word(history.filter("pinned"))
    uses = new.select("id", "_k").union(old.select("id", "_k")).distinct().groupBy("_k").count().filter("count > 1").select("_k")
    return new.join(uses, "_k", "left_semi").select("id", "keyword")


def collections(history: DataFrame) -> DataFrame:
    """Names of collections, without regard to case in order."""
    return history.filter(F.col("collection").isNotNull()).select("collection").distinct().orderBy(F.lower("collection"), "collection")


def snippet_list(history: DataFrame) -> DataFrame:
    """Pinned rows with ``position``: by collection and title, without regard to case; those without a collection first."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return numbered(history.filter("pinned"), [low("collection"), low("title"), F.col("id")], kept, "position")


def storage_category(kind: Column) -> Column:
    """What a type counts as where space is reported."""
    has = lambda *parts: F.rlike(F.lower(kind), F.lit("|".join(parts)))
    return F.when(has("image", "png", "tiff", "jpeg"), "image").when(has("file-url"), "file").when(has("rtf", "html"), "richText").when(has("text", "url", "string"), "text").otherwise("other")


def plain_text(item: Column, ocr: Column | None = None) -> Column:
    """Text of an entry's values (map<type, binary>): as UTF-8, as UTF-16, its address, or what was read in its image."""
    utf8 = F.try_validate_utf8(item["public.utf8-plain-text"].cast("string"))
    wide = F.decode(item["public.utf16-plain-text"], "UTF-16")
    url = F.try_validate_utf8(item["public.url"].cast("string"))
    return F.coalesce(utf8, wide, url, *([] if ocr is None else [ocr]))


def stack_progress(items: Column, pasted: Column) -> Column:
    """(remaining, pasted, ratio) of a stack of items to paste."""
    n = F.size(items)
    done = F.least(F.greatest(pasted, F.lit(0)), n)
    return F.struct((n - done).alias("remaining"), done.alias("pasted"), F.when(n > 0, done / n).otherwise(F.lit(0.0)).alias("ratio"))


def recognised(history: DataFrame, read: Callable[[bytes], str | None], revision: int, patterns: tuple[str, ...] = ()) -> DataFrame:
    """History (id, image binary, ocr, ocr_revision, ...) with the text of images that no reader of this revision has seen; ``read`` is a
    plug-in that executors call. Rows whose new text holds an ignored pattern are deleted."""
    todo = F.col("image").isNotNull() & ~F.coalesce(F.col("ocr_revision") >= revision, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(x) for x in b.column(1).to_pylist()], pa.string())], ["_id", "_text"])

    kind = history.schema["id"].dataType.simpleString()
    texts = history.filter(todo).select("id", "image").mapInArrow(run, f"_id {kind}, _text string")
    rows = history.join(texts, history["id"] == texts["_id"], "left")
    fresh = F.col("_id").isNotNull()
    rows = rows.withColumns({"ocr": F.when(fresh, F.col("_text")).otherwise(F.col("ocr")), "ocr_revision": F.when(fresh, F.lit(revision)).otherwise(F.col("ocr_revision"))})
    for p in patterns:
        rows = rows.filter(~(fresh & F.coalesce(F.rlike("ocr", F.lit(p)), F.lit(False))))
    return rows.select(history.columns)


def repeated_keywords(records: DataFrame) -> DataFrame:
    return records.filter(F.col("keyword").isNotNull()).groupBy(F.lower("keyword").alias("keyword")).agg(F.count("*").alias("n")).filter("n > 1")


def free_pin_keys(history: DataFrame) -> DataFrame:
    return history.agg(F.array_except(F.array(*[F.lit(c) for c in PIN_KEYS]), F.coalesce(F.collect_set("pin_key"), F.array().cast("array<string>"))).alias("free"))


def undone(current: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows as before a deletion: those added since first, then survivors and removed rows by their old positions (``pos``)."""
    back = removed.join(current.select("id"), "id", "left_anti")
    added = current.filter(F.col("pos").isNull()).withColumn("_group", F.lit(0))
    rest = current.filter(F.col("pos").isNotNull()).unionByName(back).withColumn("_group", F.lit(1))
    order = [F.col("_group"), F.col("pos"), F.desc("created_at"), F.col("id")]
    return numbered(added.unionByName(rest), order, kept, "position").drop("_group")


def payload_bytes(history: DataFrame) -> DataFrame:
    """Sum of the payloads of items array<map<string, binary>>."""
    per_item = F.transform(F.col("items"), lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, b: s + F.octet_length(b)))
    return history.agg(F.sum(F.aggregate(per_item, F.lit(0).cast("long"), lambda s, x: s + x)).alias("bytes"))


def admitted(captures: DataFrame, ignored_apps: list[str], allowed_apps: list[str], ignored_types: list[str], patterns: list[str]) -> DataFrame:
    """Captures (app, types array, text) that are stored: by app, by types, and by patterns on the first 100 000 characters."""
    keep = ~F.coalesce(F.col("app").isin(ignored_apps), F.lit(False)) if ignored_apps else F.lit(True)
    if allowed_apps:
        keep = keep & F.coalesce(F.col("app").isin(allowed_apps), F.lit(False))
    if ignored_types:
        bad = F.array(*[F.lit(t) for t in ignored_types])
        keep = keep & ~F.arrays_overlap("types", bad)
    head = F.coalesce(F.left("text", F.lit(100_000)), F.lit(""))
    for p in patterns:
        keep = keep & ~F.rlike(head, F.lit(p))
    return captures.filter(keep)


def presentation() -> Column:
    """Kind of a capture by its types array."""
    has = lambda *names: F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]))
    return F.when(has("public.file-url"), "file").when(has("public.url"), "url").when(has("public.rtf", "public.html"), "richText").when(has("public.utf8-plain-text"), "text").when(has("public.png", "public.tiff", "public.jpeg"), "image").otherwise("other")


def first_values(items: Column) -> Column:
    """array<map> to one map; the first value of each key wins."""
    entries = F.flatten(F.transform(items, F.map_entries))
    return F.aggregate(entries, F.create_map().cast("map<string,binary>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.map_from_entries(F.array(e)))))
