"""Trees of the search language to Spark column expressions.

Columns used: path, name, is_dir, size, modified, created, hidden, in_package, tags, text; only those that a query needs are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklode.functions.paths import extension, parent
from sparklode.functions.pinyin import HAN, initials
from sparklode.plans import query as q
from sparklode.plans.literals import QueryError, date_test, size_test


@dataclass(frozen=True)
class Options:
    """How a query is read: ``target`` is name, content or both; ``mode`` substring, word, wildcard or regex."""

    target: str = "name"
    mode: str = "substring"
    case_sensitive: bool = False
    include_hidden: bool = False
    include_packages: bool = False
    max_content_size: int = 0
    now: datetime = field(default_factory=datetime.now)
    first_weekday: int = 6
    pinyin: bool = True


def contains(column: Column, needle: str, case_sensitive: bool) -> Column:
    return F.contains(column, F.lit(needle)) if case_sensitive else F.contains(F.lower(column), F.lit(needle.lower()))


def wildcard(text: str) -> str:
    """A LIKE pattern of a glob."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in text)


def regex(column: Column, pattern: str, case_sensitive: bool) -> Column:
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"not a pattern: {pattern!r}") from e
    return F.rlike(column, F.lit(pattern if case_sensitive else "(?i)" + pattern))


def term(t: q.Term, column: Column, o: Options, pinyin: bool) -> Column:
    """A plain term on a name (or a text: without the path rule)."""
    mode = "substring" if t.literal else o.mode
    if mode == "word":
        return regex(column, r"\b" + re.escape(t.text) + r"\b", o.case_sensitive)
    if mode == "regex":
        return regex(column, t.text, o.case_sensitive)
    if mode == "wildcard" or not t.literal and ("*" in t.text or "?" in t.text):
        return F.like(column, F.lit(wildcard(t.text))) if o.case_sensitive else F.ilike(column, F.lit(wildcard(t.text)))
    found = contains(column, t.text, o.case_sensitive)
    if pinyin:
        found = found | (F.rlike(column, F.lit(HAN)) & F.contains(initials(column), F.lit(t.text.lower())))
    return found


def test(t: q.Test, o: Options) -> Column:
    path, is_dir = F.col("path"), F.col("is_dir")
    match t.kind:
        case "ext":
            return ~is_dir & extension(F.col("name")).isin(*sorted(t.value))
        case "file" | "folder":
            kind = is_dir if t.kind == "folder" else ~is_dir
            return kind if t.value is None else kind & contains(F.col("name"), t.value, o.case_sensitive)
        case "path":
            return contains(path, t.value, o.case_sensitive)
        case "parent":
            return parent(path) == F.lit(t.value)
        case "in":
            return F.startswith(path, F.lit(t.value.rstrip("/") + "/")) & (path != F.lit(t.value))
        case "flat":
            return (path == F.lit(t.value)) | (~is_dir & (parent(path) == F.lit(t.value)))
        case "size":
            return ~is_dir & size_test(t.value).on(F.col("size"))
        case "modified" | "created":
            return date_test(t.value, o.now, o.first_weekday).on(F.col(t.kind))
        case "tag":
            plain = F.transform("tags", lambda x: F.split_part(x, F.lit("\n"), F.lit(1)))
            one = lambda needle: F.exists(plain, lambda x: contains(x, needle, o.case_sensitive))
            found = one(t.value[0])
            for needle in t.value[1:]:
                found = found | one(needle)
            return found
    raise QueryError(f"no such filter: {t.kind}")


def compiled(node: q.Node, o: Options, content: bool = False, plain_on_text: bool = False) -> Column:
    """The tree as a nullable boolean. Without ``content`` content clauses are NULL (not known yet)."""
    pinyin = o.pinyin and all(re.fullmatch(r"[A-Za-z0-9 ]*", n.text) for n, positive in q.leaves(node) if positive and isinstance(n, q.Term))

    def go(n: q.Node) -> Column:
        match n:
            case q.Everything():
                return F.lit(True)
            case q.All(parts):
                out = go(parts[0])
                for p in parts[1:]:
                    out = out & go(p)
                return out
            case q.Any(parts):
                out = go(parts[0])
                for p in parts[1:]:
                    out = out | go(p)
                return out
            case q.Not(part):
                return ~go(part)
            case q.Content(text):
                return contains(F.col("text"), text, o.case_sensitive) if content else F.lit(None).cast("boolean")
            case q.Pattern(text):
                return regex(F.col("name"), text, o.case_sensitive)
            case q.Term(text, literal):
                if "/" in text and o.mode == "substring":
                    return regex(F.col("path"), q.segment_pattern(text), o.case_sensitive)
                if plain_on_text:
                    if not content:
                        return F.lit(None).cast("boolean")
                    return _in_text(n, o)
                return term(n, F.col("name"), o, pinyin)
        return test(n, o)

    return go(node)


def _in_text(n: q.Term, o: Options) -> Column:
    text = F.col("text")
    mode = "substring" if n.literal else o.mode
    if mode == "substring":
        return contains(text, n.text, o.case_sensitive)
    if mode == "wildcard":
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in n.text)
        return regex(text, "(?m)^" + pattern + "$", o.case_sensitive)
    return term(n, text, o, False)


def visible(o: Options) -> Column:
    out = F.lit(True)
    if not o.include_hidden:
        out = out & ~F.col("hidden")
    if not o.include_packages:
        out = out & ~F.col("in_package")
    return out


def score(name: Column, wanted: str) -> Column:
    """0 exact, 1 exact but for the extension, 2 prefix, 3 at the start of a word, 4 other. Case never counts here."""
    low, w = F.lower(name), wanted.lower()
    at = F.locate(w, low)
    before = F.substring(low, F.greatest(at - 1, F.lit(1)), F.lit(1))
    return (
        F.when(low == w, 0)
        .when(F.regexp_replace(low, r"^(.+)\.[^./]+$", "$1") == w, 1)
        .when(F.startswith(low, F.lit(w)), 2)
        .when((at > 1) & ~F.rlike(before, F.lit(r"[\p{L}\p{N}]")), 3)
        .otherwise(4)
    )


def previews(node: q.Node, o: Options, plain_on_text: bool) -> list:
    """Tests of a line, one for each positive content clause."""
    out = []
    for n, positive in q.leaves(node):
        if positive and isinstance(n, q.Content):
            out.append(lambda line, t=n.text: contains(line, t, o.case_sensitive))
        elif positive and plain_on_text and isinstance(n, q.Term) and "/" not in n.text:
            if n.literal or o.mode == "substring":
                out.append(lambda line, t=n.text: contains(line, t, o.case_sensitive))
            else:
                out.append(lambda line, t=n: term(t, line, o, False))
    return out
