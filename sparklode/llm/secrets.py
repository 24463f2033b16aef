"""Operator 10: secret scans.

An Aho-Corasick automaton of keywords finds the places worth a look; regular expressions are matched only there, anchored at the
hit; tokens that carry a check sum count only if it holds. Runs of hexadecimal digits have no keyword and are found by one
linear scan.

Base kinds: ``assign``, ``access``, ``hex``. Kinds the method adds: ``github`` (CRC-32 in the last six characters), ``npm`` (the
same), ``jwt`` (header and payload are base64url JSON objects), ``private_key`` (a PEM block whose body is base64 of DER).

Defined results: null and empty texts have no spans; texts are searched whole, whatever their length; offsets are code points;
repeated rows give equal rows; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import in_batches

# The contract's patterns and keywords.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
GITHUB = re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"(?<![A-Za-z0-9])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----([A-Za-z0-9+/=\s]{16,}+)-----END \1-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "private_key": ("-----begin",),
}
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "private_key")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[int, int, str]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def crc62(body: str) -> str:
    """CRC-32 of the text in six base-62 digits."""
    n, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _json_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _der(body: str) -> bool:
    """Base64 whose bytes start as a DER sequence of the length that follows."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    k = raw[1] & 0x7F
    return 0 < k <= 4 and len(raw) == 2 + k + int.from_bytes(raw[2 : 2 + k], "big")


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind in ("github", "npm"):
        return crc62(m[1]) == m[2]
    if kind == "jwt":
        return _json_object(m[1]) and _json_object(m[2])
    return _der(m[2])


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "private_key": PEM}


def spans(text: str | None, keys) -> list[Span]:
    """All spans of a text, by start, then kind; of one kind they don't overlap."""
    if not text:
        return []
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    lower = text.lower()
    # Lower case may be longer than the text for a few letters; then only ASCII letters are lowered.
    if len(lower) != len(text):
        lower = "".join(c.lower() if c < "\x80" else c for c in text)
    free: dict[str, int] = {}
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in keys.iter(lower))
    for at, kind in hits:
        if at < free.get(kind, 0):
            continue
        m = _PATTERNS[kind].match(text, at)
        if m:
            free[kind] = m.end()
            if _valid(kind, m):
                out.append((at, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t.as_py(), keys)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(kind))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(scan: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scanned` in Spark's own functions."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan.select(F.col("id").alias("doc_id"), *map(count, BASE_KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns with every span of the text replaced by ``mark``; overlapping spans are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = automaton()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for t in b.column(at):
                t = t.as_py()
                parts, last = [], 0
                for s, e, _ in spans(t, keys):
                    if s >= last:
                        parts += [t[last:s], mark]
                    last = max(last, e)
                out.append("".join(parts) + t[last:] if parts else t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return in_batches(docs).mapInArrow(run, docs.schema)
