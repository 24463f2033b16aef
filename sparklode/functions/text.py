"""Scalar text functions as column expressions; built-in functions only."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def metadata_text(s: Column, most: int) -> Column:
    """Trimmed and cut; NULL if nothing is left or a control character is in it."""
    t = F.trim(s)
    return F.when((t != "") & ~F.rlike(t, F.lit(r"[\p{Cc}\p{Cf}]")), F.left(t, F.lit(most)))


def bundle_id(s: Column) -> Column:
    return F.when(F.rlike(s, F.lit(r"^[A-Za-z0-9][A-Za-z0-9.-]{0,254}$")), s)


def visible_title(s: Column, visible: bool) -> Column:
    """Edge spaces as dots, tabs and line ends as arrows; else trimmed, line ends as spaces."""
    if not visible:
        return F.trim(F.regexp_replace(s, r"\r\n|\n|\r", " "))
    lead, tail = F.length(F.regexp_extract(s, "^ *", 0)), F.length(F.regexp_extract(s, "[^ ]( *)$", 1))
    body = F.substring(s, lead + 1, F.length(s) - lead - tail)
    blank = F.trim(s) == ""
    shown = F.when(blank, F.repeat(F.lit("·"), F.length(s))).otherwise(F.concat(F.repeat(F.lit("·"), lead), body, F.repeat(F.lit("·"), tail)))
    return F.translate(F.regexp_replace(shown, "\r\n", "\n"), "\t\n\r", "⇥⏎⏎")


def visible_xml(s: Column) -> Column:
    """Text of markup: a space for each tag, the five entities decoded, others kept."""
    t = F.regexp_replace(s, "<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def quoted_lines(s: Column) -> Column:
    return F.regexp_replace(s, "(?m)^", "> ")


def base64_text(s: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(s, "UTF-8")), r"[\r\n]", "")


def base64_decoded(s: Column) -> Column:
    """NULL if it isn't base64 of UTF-8."""
    return F.try_validate_utf8(F.call_function("try_to_binary", F.trim(s), F.lit("base64")).cast("string"))


def url_encoded(s: Column) -> Column:
    """Percent encoding that leaves the characters a query may hold."""
    t = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for c in "!$'()*,:;=@?/~&":
        t = F.replace(t, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return t


def url_decoded(s: Column) -> Column:
    return F.call_function("try_url_decode", F.replace(s, F.lit("+"), F.lit("%2B")))


def json_minified(s: Column) -> Column:
    """Keys sorted, no white space; NULL if it isn't JSON."""
    return F.to_json(F.try_parse_json(s))


def json_pretty(s: Column) -> Column:
    """Keys sorted, two spaces; NULL if it isn't JSON. Spark has no pretty printer, so this one is an Arrow function."""
    @F.pandas_udf("string")
    def pretty(x: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return x.map(one)

    return pretty(s)


#: Transforms of a text by name; a dictionary to add to.
TRANSFORMS = {
    "trim": F.trim,
    "upper": F.upper,
    "lower": F.lower,
    "quote": quoted_lines,
    "json.minify": json_minified,
    "json.pretty": json_pretty,
    "url.encode": url_encoded,
    "url.decode": url_decoded,
    "base64.encode": base64_text,
    "base64.decode": base64_decoded,
}


def applicable(s: Column) -> Column:
    """Names of the built-in transforms that a text allows."""
    ok = {
        "trim": F.lit(True), "upper": F.lit(True), "lower": F.lit(True), "quote": F.lit(True),
        "json.minify": F.try_parse_json(s).isNotNull(), "json.pretty": F.try_parse_json(s).isNotNull(),
        "url.encode": F.lit(True), "url.decode": url_decoded(s).isNotNull() & (url_decoded(s) != s),
        "base64.encode": F.lit(True), "base64.decode": base64_decoded(s).isNotNull() & (F.trim(s) != ""),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in ok.items()]), lambda x: x.isNotNull())


_TOKEN = re.compile(r"\{\{([^{}]+)\}\}|\{([^{}]+)\}")


def rendered(template: str, now: datetime, clipboard: str = "", uuid: str = "") -> tuple[str, int | None]:
    """The text of a snippet, and where the cursor goes (the last ``cursor`` wins); unknown tokens are kept."""
    formats = {"date": "yyyy-MM-dd", "time": "HH:mm", "datetime": "yyyy-MM-dd HH:mm"}
    codes = (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"))

    def dated(pattern: str) -> str:
        for a, b in codes:
            pattern = pattern.replace(a, b)
        return now.strftime(pattern)

    parts, last, cursor = [], 0, None
    for m in _TOKEN.finditer(template):
        name = (m[1] or m[2]).strip()
        key, _, argument = name.partition(":")
        parts.append(template[last : m.start()])
        last = m.end()
        if key in formats and (not argument or key != "datetime"):
            parts.append(dated(argument or formats[key]))
        elif name == "clipboard":
            parts.append(clipboard)
        elif name == "uuid":
            parts.append(uuid)
        elif name == "cursor":
            cursor = len("".join(parts))
        else:
            parts.append(m[0])
    return "".join(parts) + template[last:], cursor


_ANY = r"\{\{[^{}]+\}\}|\{[^{}]+\}"


def rendered_rows(template: Column, now: Column, clipboard: Column, uuid: Column) -> Column:
    """:func:`rendered` for a column of templates: (text, cursor); cursor is NULL without one."""

    def dated(pattern: Column) -> Column:
        for code in ("yyyy", "MM", "dd", "HH", "mm", "ss"):
            pattern = F.replace(pattern, F.lit(code), F.date_format(now, code))
        return pattern

    def value(token: Column) -> Column:
        name = F.trim(F.regexp_replace(token, r"^\{+|\}+$", ""))
        key, argument = F.substring_index(name, ":", 1), F.when(F.contains(name, F.lit(":")), F.regexp_replace(name, "^[^:]*:", ""))
        given = F.nullif(argument, F.lit(""))
        return (
            F.when(key == "date", dated(F.coalesce(given, F.lit("yyyy-MM-dd"))))
            .when(key == "time", dated(F.coalesce(given, F.lit("HH:mm"))))
            .when((key == "datetime") & given.isNull(), dated(F.lit("yyyy-MM-dd HH:mm")))
            .when(name == "clipboard", F.coalesce(clipboard, F.lit("")))
            .when(name == "uuid", F.coalesce(uuid, F.lit("")))
            .when(name == "cursor", F.lit(""))
            .otherwise(token)
        )

    found = F.regexp_extract_all(template, F.lit(_ANY), F.lit(0))
    gaps = F.split(template, _ANY, -1)
    parts = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.transform(found, value), i), F.lit(""))))
    marks = F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"^\{+|\}+$", "")) == "cursor")
    last = F.array_max(F.transform(marks, lambda m, i: F.when(m, i)))
    cursor = F.when(last.isNotNull(), F.length(F.array_join(F.slice(parts, F.lit(1), last + 1), "")))
    return F.struct(F.array_join(parts, "").alias("text"), cursor.alias("cursor"))


def normalized_strings(values: Column, count: int = 128, length: int = 512) -> Column:
    """Settings as a sorted set: trimmed, without empty, long or odd ones, and no more than ``count``."""
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    good = F.filter(trimmed, lambda v: (v != "") & (F.length(v) <= length) & ~F.rlike(v, F.lit(r"[\p{Cc}\p{Cf}]")))
    return F.slice(F.array_sort(F.array_distinct(good)), 1, count)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def search_memory(size: Column, budget: int) -> Column:
    """Bytes to allow for the search of a text of so many: three times its size, a MiB at least, within the budget."""
    return F.least(F.lit(budget).cast("long"), F.greatest(F.lit(1 << 20).cast("long"), 3 * size))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))


def colour(s: Column) -> Column:
    """#rgb, #rgba, #rrggbb or #rrggbbaa to (r, g, b, a) in 0 to 1; NULL otherwise."""
    h = F.substring(F.trim(s), 2, 8)
    long = F.when(F.length(h) <= 4, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    full = F.when(F.length(long) == 6, F.concat(long, F.lit("ff"))).otherwise(long)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255
    good = F.rlike(F.trim(s), F.lit(r"^#([0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"))
    return F.when(good, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a")))


def duration(seconds: Column, with_seconds: bool = False) -> Column:
    """h:mm, rounded up to the minute, or h:mm:ss, rounded up to the second."""
    s = F.ceil(F.greatest(seconds, F.lit(0))).cast("long")
    if with_seconds:
        return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    m = F.ceil(s / 60).cast("long")
    return F.format_string("%d:%02d", F.floor(m / 60), m % 60)


def reference_time(seconds: Column) -> Column:
    """Seconds since 2001-01-01 UTC to a timestamp."""
    return F.timestamp_seconds(seconds + F.lit(978_307_200))


def ipv4_number(s: Column) -> Column:
    """A dotted address as a number; NULL if it isn't one."""
    parts = F.split(s, r"\.")
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + F.get(parts, i).try_cast("long")
    good = F.rlike(s, F.lit(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"))
    return F.when(good, total)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def ip_key(s: Column) -> Column:
    """Any address as text that orders like it within a family: 4 and 8 hexadecimal digits, or 6 and 32; NULL if it isn't one. Its zone is left out."""
    groups = lambda part: F.array_remove(F.split(F.coalesce(part, F.lit("")), ":"), "")
    digits = lambda number: F.lpad(F.lower(F.hex(number)), 8, "0")

    def dotted_end(plain: Column) -> Column:
        # A dotted end stands for two groups.
        head = F.regexp_replace(plain, r"[^:]*$", "")
        return bound(digits(ipv4_number(F.substring_index(plain, ":", -1))), lambda tail: F.when(tail.isNull(), plain).otherwise(F.concat(head, F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))))

    def six(whole: Column) -> Column:
        halves = F.split(whole, "::")
        shape = F.rlike(whole, F.lit("^(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?(::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)?$"))

        def filled(sides: Column) -> Column:
            missing = 8 - F.size(sides["l"]) - F.size(sides["r"])
            good = shape & F.when(whole.contains("::"), missing >= 1).otherwise(missing == 0)
            padded = F.transform(F.concat(sides["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["r"]), lambda g: F.lpad(g, 4, "0"))
            return F.when(good, F.concat(F.lit("6"), F.array_join(padded, "")))

        return bound(F.struct(groups(F.get(halves, 0)).alias("l"), groups(F.get(halves, 1)).alias("r")), filled)

    either = lambda plain: F.when(plain.contains(":"), bound(dotted_end(plain), six)).otherwise(F.concat(F.lit("4"), digits(ipv4_number(plain))))
    return bound(F.lower(F.substring_index(s, "%", 1)), either)


def ip_key_of(s: str | None) -> str | None:
    """:func:`ip_key` of one address."""
    try:
        a = ipaddress.ip_address((s or "").split("%")[0])
    except ValueError:
        return None
    return f"{a.version}{a.packed.hex()}"


def ip_struct(s: Column) -> Column:
    """(family, bytes) of any address, without its zone; ordered by bytes within a family. IPv6 has no built-in parser."""
    @F.pandas_udf("family int, bytes binary")
    def parse(x: pd.Series) -> pd.DataFrame:
        from ipaddress import ip_address

        def one(t):
            try:
                a = ip_address(t.split("%")[0]) if isinstance(t, str) and len(t) <= 64 else None
            except ValueError:
                a = None
            return (None, None) if a is None else (a.version, a.packed)

        return pd.DataFrame([one(t) for t in x], columns=["family", "bytes"]).astype({"family": "Int32"})

    return parse(s)


# Bits of a change event and their names, in order.
EVENT_KEYS = (
    (0x100, "Created"), (0x200, "Removed"), (0x800, "Renamed"), (0x1000, "Modified"), (0x400, "InodeMetaMod"), (0x2000, "FinderInfoMod"),
    (0x4000, "ChangeOwner"), (0x8000, "XattrMod"), (0x400000, "Cloned"), (0x1, "MustScanSubDirs"), (0x2, "EventsDropped"),
    (0x4, "EventsDropped"), (0x20, "RootChanged"), (0x10, "HistoryDone"),
)
IS_FILE, IS_FOLDER, IS_LINK, RENAMED = 0x10000, 0x20000, 0x40000, 0x800
STRUCTURAL, METADATA, RESCAN = 0x100 | 0x200 | 0x400000, 0x400 | 0x4000 | 0x8000 | 0x2000, 0x1 | 0x2 | 0x4 | 0x8 | 0x20


def event_keys(flags: Column) -> Column:
    keys = F.array_distinct(F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(b)) != 0, F.lit(k)) for b, k in EVENT_KEYS]), lambda x: x.isNotNull()))
    return F.when(F.size(keys) == 0, F.array(F.lit("Changed"))).otherwise(keys)


def event_class(flags: Column) -> Column:
    """exact, subtree, parent (a subtree one level up) or metadata: what a change event makes necessary."""
    has = lambda bits: flags.bitwiseAND(F.lit(bits)) != 0
    return (
        F.when(has(IS_FILE | IS_LINK), "exact")
        .when(has(RENAMED), F.when(has(IS_FOLDER), "subtree").otherwise("parent"))
        .when(has(IS_FOLDER), F.when(has(STRUCTURAL), "subtree").when(has(METADATA), "metadata").otherwise("exact"))
        .otherwise("subtree")
    )


def synthetic_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"^/+\.docid/+\d+/+changed/+\d+/+src=\d+,dst=\d+/*$"))
