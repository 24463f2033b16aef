"""The search language: text -> tokens -> tree. No Spark here.

Juxtaposition is AND, and OR binds tighter than AND: ``a b|c d`` is ``a AND (b OR c) AND d``.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from sparklode.plans.literals import QueryError, date_test, size_test


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Term:
    """A plain word; ``literal`` if it was quoted."""

    text: str
    literal: bool = False


@dataclass(frozen=True)
class Content:
    text: str


@dataclass(frozen=True)
class Pattern:
    """``regex:`` on the name."""

    text: str


@dataclass(frozen=True)
class Test:
    """A filter: ``kind`` names it, ``value`` is its argument."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Node = Everything | Term | Content | Pattern | Test | All | Any | Not

# Extensions by kind of file, and the names of kinds.
EXTENSIONS = {
    "picture": "jpg jpeg png gif heic heif tiff tif bmp webp svg",
    "video": "mov mp4 m4v avi mkv webm hevc",
    "audio": "mp3 m4a aac wav aiff aif flac ogg",
    "doc": "txt rtf md pdf doc docx pages odt",
    "presentation": "ppt pptx key odp",
    "spreadsheet": "xls xlsx numbers csv tsv ods",
    "pdf": "pdf",
    "archive": "zip rar 7z tar gz bz2 xz dmg",
    "code": "swift rs ts tsx js jsx py rb go java kt c h cpp hpp m mm cs php html css json xml yaml yml toml sh",
    "exe": "app command tool sh bin xpc appex",
}
KIND_NAMES = {
    "picture": "picture pictures image images photo photos",
    "video": "video videos movie movies",
    "audio": "audio audios music song songs",
    "doc": "doc docs document documents text office",
    "presentation": "presentation presentations ppt slides",
    "spreadsheet": "spreadsheet spreadsheets xls excel sheet sheets",
    "pdf": "pdf",
    "archive": "archive archives compressed zip",
    "code": "code source dev",
    "exe": "exe exec executable executables program programs app apps",
}
KIND_OF = {name: kind for kind, names in KIND_NAMES.items() for name in names.split()}
COMPARED = frozenset("size: dm: modified: date: datemodified: dc: created: datecreated:".split())
KEYS = {
    "ext": "ext", "extension": "ext", "file": "file", "folder": "folder", "dir": "folder", "path": "path", "parent": "parent",
    "in": "in", "infolder": "in", "nosubfolders": "flat", "content": "content", "type": "type", "audio": "macro", "video": "macro",
    "doc": "macro", "exe": "macro", "size": "size", "dm": "modified", "modified": "modified", "date": "modified",
    "datemodified": "modified", "dc": "created", "created": "created", "datecreated": "created", "tag": "tag", "t": "tag", "regex": "regex",
}


def tokens(query: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, quoted); kinds are word, and, or, not, open, close."""
    word, quoted, inside, angles = [], False, False, 0
    at, n = 0, len(query)
    out: list[tuple[str, str, bool]] = []

    def finish() -> None:
        nonlocal quoted
        if not word:
            return
        text = "".join(word)
        word.clear()
        operator = text.lower() if not quoted and text.lower() in ("and", "or", "not") else ""
        out.append((operator, "", False) if operator else ("word", text, quoted))
        quoted = False

    while at < n:
        c = query[at]
        at += 1
        if c == '"':
            inside, quoted = not inside, True
        elif inside:
            if c == "\\" and at < n:
                c = query[at]
                at += 1
            word.append(c)
        elif c in " \t\r\n":
            finish()
        elif c in "()|":
            finish()
            out.append(({"(": "open", ")": "close", "|": "or"}[c], "", False))
        elif c in "<!" and not word:
            out.append(("open" if c == "<" else "not", "", False))
            angles += c == "<"
        elif c == ">" and angles and "".join(word).lower() not in COMPARED:
            finish()
            out.append(("close", "", False))
            angles -= 1
        else:
            word.append(c)
    if inside or angles:
        raise QueryError("a quote or a group isn't closed")
    finish()
    return iter(out)


def _absolute(text: str) -> str:
    if text[:1] not in ("/", "~"):
        raise QueryError(f"not an absolute path: {text!r}")
    return normalized(text)


def normalized(path: str) -> str:
    """Home, double slashes, dots and a slash at the end worked out."""
    path = posixpath.normpath(posixpath.expanduser(path) if path.startswith("~") else path)
    return path[1:] if path.startswith("//") else path


def _extensions(text: str) -> frozenset[str]:
    found = frozenset(x for x in (e.strip(" \t\r\n.").lower() for e in text.split(";")) if x)
    if not found:
        raise QueryError(f"no extension: {text!r}")
    return found


def _kind(name: str) -> frozenset[str]:
    kind = KIND_OF.get(name.strip().lower())
    if kind is None:
        raise QueryError(f"no such type: {name!r}")
    return frozenset(EXTENSIONS[kind].split())


def clause(text: str, quoted: bool) -> Node:
    """The meaning of one word; unknown keys are part of a plain term, and quotes don't disable known ones."""
    head, colon, tail = text.partition(":")
    key = KEYS.get(head.lower()) if colon else None
    if key is None:
        if not colon and not quoted and text.startswith("*."):
            try:
                return Test("ext", _extensions(text[2:]))
            except QueryError:
                pass
        return Term(text, quoted)
    value = tail.strip()
    if key in ("path", "content", "regex") and not value:
        raise QueryError(f"{head}: needs a value")
    match key:
        case "ext":
            return Test("ext", _extensions(value))
        case "type":
            return Test("ext", _kind(value))
        case "macro":
            files = Test("ext", _kind(head))
            return All((files, Term(value, quoted))) if value else files
        case "file" | "folder":
            return Test(key, value or None)
        case "path":
            return Test(key, value)
        case "parent" | "in" | "flat":
            return Test(key, _absolute(value))
        case "content":
            return Content(value)
        case "regex":
            return Pattern(value)
        case "tag":
            tags = tuple(t for t in value.split(";") if t)
            if not tags:
                raise QueryError("tag: needs a value")
            return Test("tag", tags)
        case _:
            # Read once here, so that a bad value makes the whole query invalid; dates are resolved again at compile time.
            size_test(value) if key == "size" else date_test(value, datetime(2000, 1, 1))
            return Test(key, value)


def parse(query: str) -> Node:
    """The tree of a query; raises :class:`QueryError`. An empty query is everything."""
    line = list(tokens(query))
    at = 0

    def kind() -> str:
        return line[at][0] if at < len(line) else ""

    def step() -> tuple[str, str, bool]:
        nonlocal at
        at += 1
        return line[at - 1]

    def both() -> Node:
        parts = [either()]
        while kind() not in ("", "close"):
            if kind() == "and":
                step()
            parts.append(either())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def either() -> Node:
        parts = [single()]
        while kind() == "or":
            step()
            parts.append(single())
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def single() -> Node:
        what = kind()
        if what == "not":
            step()
            return Not(single())
        if what == "open":
            step()
            inner = both()
            if kind() != "close":
                raise QueryError("a group isn't closed")
            step()
            return inner
        if what == "word":
            _, text, quoted = step()
            return clause(text, quoted)
        raise QueryError("an operator has nothing to work on")

    if not line:
        return Everything()
    tree = both()
    if at != len(line):
        raise QueryError("a group isn't open")
    return tree


def leaves(node: Node, positive: bool = True) -> Iterator[tuple[Node, bool]]:
    """Leaves in order, and whether they stand under an even number of NOTs."""
    if isinstance(node, Not):
        yield from leaves(node.part, not positive)
    elif isinstance(node, All | Any):
        for p in node.parts:
            yield from leaves(p, positive)
    else:
        yield node, positive


def ranking_term(node: Node) -> str | None:
    """The longest positive plain term, the first of equals."""
    terms = [n.text for n, positive in leaves(node) if positive and isinstance(n, Term)]
    return max(terms, key=len, default=None)


def reads_content(node: Node) -> bool:
    return any(isinstance(n, Content) for n, _ in leaves(node))


def needs_metadata(node: Node) -> bool:
    """Whether sizes, dates or contents must be complete before the query may run."""
    return any(isinstance(n, Content) or isinstance(n, Test) and n.kind in ("size", "modified", "created") for n, _ in leaves(node))


def required_literals(node: Node) -> frozenset[str]:
    """Lower-case ASCII content literals of three letters or more that every match holds: for prefilters, which may only err by keeping too much."""
    if isinstance(node, Content):
        text = node.text.lower()
        return frozenset([text]) if len(text) >= 3 and text.isascii() else frozenset()
    if isinstance(node, All):
        return frozenset().union(*(required_literals(p) for p in node.parts))
    if isinstance(node, Any):
        found = [required_literals(p) for p in node.parts]
        return frozenset.intersection(*found)
    return frozenset()


def segment_pattern(path_term: str) -> str:
    """A regular expression over a whole path for a term with slashes: its segments in a row, the outer ones cut short where no slash bounds them."""
    bounded_left, bounded_right = path_term.startswith("/"), path_term.endswith("/")
    parts = [p for p in path_term.split("/") if p]
    if not parts:
        return "^"
    any_in = "[^/]*"
    out = ""
    for i, p in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        if p == "**":
            out += "" if last else "(?:[^/]+/)*"
            if last and out.endswith("/"):
                out = out[:-1] + "(?:/|$)"
            continue
        if "*" in p or "?" in p:
            body = "".join(any_in if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
        else:
            open_left = first and not bounded_left
            open_right = last and not bounded_right
            body = (any_in if open_left else "") + re.escape(p) + (any_in if open_right else "")
        out += body + ("(?:/|$)" if last else "/")
    return "(?:^|/)" + out
