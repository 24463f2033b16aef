"""Operator 3: personal data.

Fixed patterns give the base spans. A linear-chain conditional random field over word shapes adds what the patterns can't hold:
telephone and card numbers that a pattern has run together with the number after them (and so has dropped), addresses with ``(at)`` or
``at`` and ``dot``, telephone numbers without a plus sign, card numbers in dotted or slashed groups. It is trained on the driver from a small labelled table made by rule (:func:`labelled_table`), and decoded by
Viterbi over numpy batches.

A word without a digit, an at/dot marker nearby or a cue before it is held to the label "outside", in training and in decoding.
So a text falls into segments between such words, each of which is decoded exactly, and prose costs only the search for digits.

Defined results: null and empty texts have no spans; texts are searched whole; offsets are code points; repeated rows give equal
rows; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import in_batches
from sparklode.llm.textkernel import utf8

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. The run before an at sign is extended by hand, so that no pattern can go back and forth over it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            yield s, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its test, by kind, then start."""
    out: list[Span] = [(s, e, "email") for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


# ---------------------------------------------------------------- the field

LABELS = ("O", "B-email", "I-email", "B-card", "I-card", "B-phone", "I-phone")
MARKS = frozenset(("(at)", "[at]", "{at}", "dot", "(dot)", "[dot]", "{dot}"))
CUES = frozenset("phone tel telephone call mobile fax email mail contact card visa mastercard".split())
# Ends of host names that are told from other words.
ENDS = frozenset("com org net edu gov info io de fr es uk eu".split())
_DIGIT = re.compile("[0-9]")
START = np.array([0.0, 0.0, -1e4, 0.0, -1e4, 0.0, -1e4])


def shape(word: str) -> str:
    """Letters a, digits by count up to 4 and then +, other signs as they are; markers and cue words keep their letters."""
    low = word.lower()
    if low in MARKS:
        return low.strip("([{}])") + "*"
    bare = low.strip(".,;:!?()")
    if bare in CUES:
        return "cue:" + bare
    if bare in ENDS or bare == "at":
        return "end" if bare in ENDS else "at"
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word):
        p = m[0]
        if p[0].isdigit() and p.isascii():
            out.append(str(len(p)) if len(p) <= 4 else "+")
        elif p[0].isalpha():
            out.append("a")
        else:
            out.append(p)
    return "".join(out)


def features(sequence: list[str]) -> list[list[str]]:
    """Names of the features of each word: its own shape, its neighbours' and both together."""
    s = ["<", *map(shape, sequence), ">"]
    return [[f"0{s[i]}", f"-{s[i - 1]}", f"+{s[i + 1]}", f"p{s[i - 1]}|{s[i]}", f"n{s[i]}|{s[i + 1]}"] for i in range(1, len(s) - 1)]


def labelled_table(rows: int = 1000, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, labels): carrier words with one planted item or a look-alike, by rule from ``seed``."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    name = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(3, 9))))
    pick = lambda *x: x[int(r.integers(len(x)))]
    carrier = lambda: [name() + pick("", "", "", ".", ",") for _ in range(int(r.integers(0, 4)))]
    out = []
    for k in range(rows):
        a, kind = [], "O"
        match k % 20:
            case 0:
                at, dot = pick("(at)", "[at]", "{at}"), pick("dot", "(dot)", "[dot]")
                a, kind = [name(), at, name(), dot, pick("com", "org", "net", "de")], "email"
            case 1:
                at, dot = pick("(at)", "[at]"), pick("dot", "(dot)")
                a, kind = [name(), dot, name(), at, name(), dot, pick("com", "org")], "email"
            case 2:
                a, kind = [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"
            case 3:
                a, kind = [f"{digits(3)}-{digits(3)}-{digits(4)}"], "phone"
            case 4:
                a, kind = [pick("(", "") + digits(3) + pick(")", ""), digits(3), digits(4)], "phone"
                a = [pick("phone", "tel", "call", "mobile"), *a]
            case 5:
                sep = pick(".", "/")
                a, kind = [sep.join(digits(4) for _ in range(4))], "card"
            case 6:
                a, kind = [digits(int(r.integers(13, 20)))], "card"  # its check sum is tested afterwards
            case 12:
                a, kind = [f"+{digits(int(r.integers(1, 4)))}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"
            case 13:
                a, kind = [f"+{digits(int(r.integers(1, 4)))}", digits(int(r.integers(2, 5))), digits(int(r.integers(3, 9)))], "phone"
            case 14:
                a, kind = [digits(4) for _ in range(4)], "card"
            case 15:
                a, kind = [name() + pick("", f".{name()}", digits(2)), pick("at", "AT"), name(), pick("dot", "DOT"), pick(*sorted(ENDS))], "email"
            case 16:
                a = [pick("look", "stay", "meet", name()), "at", pick("the", name()), pick("dot", name()), name()]
            case 17:
                a, kind = [f"0{digits(int(r.integers(2, 5)))}{pick('/', '-')}{digits(int(r.integers(5, 9)))}"], "phone"
            case 18:
                a = [name(), pick("at", "dot"), name(), digits(int(r.integers(1, 5)))]
            case 7:
                a = [".".join(digits(int(r.integers(1, 4))) for _ in range(4))]
            case 8:
                a = [pick(digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)}.{digits(2)}", f"{name()}{digits(2)}")]
            case 9:
                a = [pick("token", "key", "id"), "=", f'"{digits(3)}{name()}{digits(5)}{name()}"']
            case 10 | 19:
                a = [f"{name()}.{digits(2)}@{name()}.com", digits(int(r.integers(1, 7)))]
            case _:
                a = [pick("(", "") + digits(int(r.integers(1, 5))) + pick(")", ",", "."), digits(int(r.integers(1, 3))), name()]
        tags = ["O"] * len(a) if kind == "O" else [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(a))]
        if k % 20 == 17:
            a, tags = [pick("phone", "tel", "call", "mobile", "fax"), *a], ["O", *tags]
        if k % 20 in (6, 12, 13, 14) and r.random() < 0.6:  # a number stands right after it
            more = [pick(".".join(digits(int(r.integers(1, 4))) for _ in range(4)), digits(int(r.integers(1, 5))), digits(int(r.integers(13, 20))))]
            if len(more[0]) < 13 or "." in more[0]:
                a, tags = [*a, *more], [*tags, "O"]
        elif k % 20 == 6 and r.random() < 0.5:  # or another card
            a, tags = [*a, digits(16)], [*tags, "B-card"]
        if k % 20 == 4:
            tags = ["O", *tags[:1], *(t.replace("B-", "I-") for t in tags[1:-1])]
        before, after = carrier(), carrier()
        if a:
            a[-1] += pick("", "", "", ".", ",")
        out.append(([*before, *a, *after], ["O"] * len(before) + tags + ["O"] * len(after)))
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of the field: ``emit`` (features x labels), ``move`` (labels x labels), and the features' numbers."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, sequences: list[list[str]], free: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, position, label) scores, padded, and the lengths; a word that isn't free has the label O."""
        length = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(length.max(initial=1)), len(LABELS)))
        for i, s in enumerate(sequences):
            for j, f in enumerate(features(s)):
                at = [self.names[n] for n in f if n in self.names]
                if at:
                    out[i, j] = self.emit[at].sum(axis=0)
                if not free[i][j]:
                    out[i, j, 1:] = -1e4
        return out, length

    def decode(self, sequences: list[list[str]], free: list[np.ndarray], batch: int = 2048) -> list[list[str]]:
        """Viterbi over batches of sequences of like length."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out: list[list[str]] = [[] for _ in sequences]
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            e, length = self.scores([sequences[i] for i in at], [free[i] for i in at])
            n, width, _ = e.shape
            best, back = e[:, 0] + START, np.zeros(e.shape, np.int8)
            for j in range(1, width):
                step = best[:, :, None] + self.move[None]
                back[:, j] = step.argmax(axis=1)
                best = np.where((j < length)[:, None], step.max(axis=1) + e[:, j], best)
            label = best.argmax(axis=1)
            path = np.zeros((n, width), np.int8)
            rows = np.arange(n)
            for j in range(width - 1, -1, -1):
                path[:, j] = label
                label = np.where((j < length) & (j > 0), back[rows, j, label], label)
            for r, i in enumerate(at):
                out[i] = [LABELS[x] for x in path[r, : length[r]]]
        return out


def trained(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 100, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam; deterministic."""
    table = labelled_table() if table is None else table
    names: dict[str, int] = {}
    feats = [[[names.setdefault(n, len(names)) for n in f] for f in features(w)] for w, _ in table]
    width, rows, k = max(len(w) for w, _ in table), len(table), len(LABELS)
    feat = np.full((rows, width, 5), len(names))
    gold, length, held = np.zeros((rows, width), int), np.zeros(rows, int), np.zeros((rows, width), bool)
    for i, (w, tags) in enumerate(table):
        length[i] = len(w)
        feat[i, : len(w)] = feats[i]
        gold[i, : len(w)] = [LABELS.index(t) for t in tags]
        held[i, : len(w)] = ~free_words(w)
    mask = np.arange(width)[None] < length[:, None]
    bad = np.zeros((k, k))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                bad[i, j] = -1e4
    emit, move = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    moment = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    hot = np.eye(k)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    for step in range(1, steps + 1):
        e = emit[feat].sum(axis=2)
        e[..., 1:] -= 1e4 * held[..., None]
        t = move + bad
        alpha = np.zeros((rows, width, k))
        alpha[:, 0] = e[:, 0] + START
        for j in range(1, width):
            alpha[:, j] = np.where(mask[:, j, None], _logsumexp(alpha[:, j - 1, :, None] + t[None], 1) + e[:, j], alpha[:, j - 1])
        z = _logsumexp(alpha[:, -1], 1)
        beta = np.zeros((rows, width, k))
        for j in range(width - 2, -1, -1):
            beta[:, j] = np.where(mask[:, j + 1, None], _logsumexp(t[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), beta[:, j + 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, feat.reshape(-1), np.repeat((hot - p).reshape(-1, k), 5, axis=0))
        g_move = np.einsum("rja,rjb->ab", hot[:, :-1] * pairs[..., None], hot[:, 1:]) - both.sum(axis=(0, 1))
        for w, g, m, v in zip((emit, move), (g_emit / rows - ridge * emit, g_move / rows - ridge * move), *moment, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        emit[-1] = 0
    return Field(names, emit[:-1], move + bad)


@lru_cache
def usual() -> Field:
    """The field of the usual table, trained once."""
    return trained()


def free_words(sequence: list[str]) -> np.ndarray:
    """Which words may be part of an item: those with a digit, and markers with two words on either side."""
    n = len(sequence)
    out = np.array([_DIGIT.search(w) is not None for w in sequence], bool)
    for i, w in enumerate(sequence):
        low = w.lower().rstrip(".,")
        if low in MARKS:
            out[max(0, i - 2) : i + 3] = True
            for j in range(max(0, i - 3), i):  # a plain "at" counts where a dot word follows
                if sequence[j].lower() == "at":
                    out[max(0, j - 1) : i + 2] = True
    return out[:n]


def _extent(word: str, first: bool, last: bool, kind: str) -> tuple[int, int]:
    """Where the item starts and ends inside its first or last word: without punctuation around it."""
    a, b = 0, len(word)
    if first:
        a = len(word) - len(word.lstrip(".,;:!?\"'" if kind == "phone" else ".,;:!?\"'("))
    if last:
        m = re.search(r"[A-Za-z0-9](?=[^A-Za-z0-9]*$)", word)
        b = m.end() if m else b
    return a, b


def segments(text: str) -> list[tuple[list[str], list[int], np.ndarray]]:
    """Segments of a text to decode: words, their starts, and which are free."""
    found = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    seq = [w for _, w in found]
    free = free_words(seq)
    out, i, n = [], 0, len(seq)
    while i < n:
        if not free[i]:
            i += 1
            continue
        j = i
        while j < n and free[j]:
            j += 1
        a, b = max(0, i - 1), min(n, j + 1)
        out.append((seq[a:b], [s for s, _ in found[a:b]], free[a:b]))
        i = j
    return out


def _items(seq: list[str], starts: list[int], tags: list[str]) -> Iterator[Span]:
    i = 0
    while i < len(tags):
        if tags[i] == "O":
            i += 1
            continue
        kind, j = tags[i][2:], i + 1
        while j < len(tags) and tags[j] == f"I-{kind}":
            j += 1
        a, _ = _extent(seq[i], True, False, kind)
        _, b = _extent(seq[j - 1], False, True, kind)
        text = "".join(seq[i:j])
        digits = "".join(c for c in text if c in "0123456789")
        good = {"phone": 9 <= len(digits) <= 15, "card": 13 <= len(digits) <= 19 and luhn(digits or "1"), "email": j - i >= 3 and "at" in text.lower() and "dot" in text.lower()}[kind]
        if good:
            yield starts[i] + a, starts[j - 1] + b, kind
        i = j


def found_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """All spans of each text, by kind, then start: the base ones, and those of the field that overlap none of them."""
    base = [base_spans(t) for t in texts]
    jobs = [(k, *s) for k, t in enumerate(texts) for s in segments(t)]
    tags = field.decode([j[1] for j in jobs], [j[3] for j in jobs]) if jobs else []
    out = [list(b) for b in base]
    for (k, seq, starts, _), t in zip(jobs, tags, strict=True):
        for s, e, kind in _items(seq, starts, t):
            if all(e <= a or b <= s for a, b, _ in base[k]):
                out[k].append((s, e, kind))
    return [sorted(o, key=lambda x: (KINDS.index(x[2]), x[0], x[1])) for o in out]


def _suspects(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a digit, an at sign or the letters of a marker; others can have no span."""
    hit = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    n = len(raw)
    if n >= 3:
        low = raw | np.uint8(32)
        hit[: n - 2] |= (low[: n - 2] == ord("d")) & (low[1 : n - 1] == ord("o")) & (low[2:] == ord("t"))
        bracket = (raw == ord("(")) | (raw == ord("[")) | (raw == ord("{"))
        hit[: n - 2] |= bracket[: n - 2] & (low[1 : n - 1] == ord("a")) & (low[2:] == ord("t"))
    at = np.flatnonzero(hit)
    return np.searchsorted(at, off[1:]) > np.searchsorted(at, off[:-1])


def scanned(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for every row; spans are arrays of (kind, start, end)."""
    field = field or usual()
    held = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand weights, whatever the input
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = np.flatnonzero(_suspects(*utf8(b.column(1))))
            texts = [b.column(1)[int(i)].as_py() for i in maybe]
            every: list[list[dict]] = [[] for _ in range(b.num_rows)]
            base: list[list[dict]] = [[] for _ in range(b.num_rows)]
            entry = lambda x: {"kind": x[2], "start": x[0], "end": x[1]}
            for i, t, s in zip(maybe, texts, found_spans(texts, held.value), strict=True):
                every[i] = list(map(entry, s))
                base[i] = list(map(entry, base_spans(t))) if s else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(kind)), pa.array(every, pa.list_(kind))], ["id", "base", "spans"])

    column = "array<struct<kind:string,start:int,end:int>>"
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, base {column}, spans {column}")


def digest(scan: DataFrame) -> DataFrame:
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
