"""Operator 1: SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut before each run of spaces into marked words, around letters that the vocabulary has only by themselves, and between
ASCII letters that stand next to each other in no piece (no piece reaches across such cuts). The distinct marked words of a batch
are sorted, which lays them out as a trie in depth-first order: going from one word to the next, the forward states of their
common prefix are kept and only the new letters are worked on. Each distinct word is walked once, however often it occurs.

The forward state of a prefix depends on the model. For a unigram model it is the best score of the prefix (Viterbi). A BPE model has
no additive score, so there the state is the last piece of the prefix's encoding: it is the one piece that ends there and
stands next to the state at its start without the pair merging otherwise. Both give the library's ids exactly. Words with two
or more leading spaces meet pieces of equal score, and are merged directly.

Decoding maps ids to bytes. The round trip is exact up to the model's own rule that U+2581 is a space.

Defined results: null and empty texts have no ids; letters outside the vocabulary become byte pieces (or the unknown id, for a model
without them); repeated rows get equal rows; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import in_batches
from sparklode.llm.textkernel import equal_ranges, ranges, slices, utf8, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of texts whose distinct words are one trie, and the words whose ids a worker remembers from one trie to the next at most.
CHUNK, KNOWN = 2 << 20, 200_000
#: Bytes of these words at most, but for those of one trie.
KNOWN_BYTES = 8 << 20
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, kind, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces, scores and kinds of a model file; small and of fixed size, so it may be sent to every executor."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds, self.bpe = [], [], [], False
        for number, _, value in _fields(data):
            if number == 1:
                f = {n: v for n, _, v in _fields(value)}
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.bpe = {n: v for n, _, v in _fields(value)}.get(3, 1) == 2
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        #: Of each byte: whether it is a letter that stands in no piece but by itself (digits and line ends, as a rule); and of each two
        #: ASCII letters, as 128 * a + b: whether they stand next to each other in no piece. Nothing is merged across such places.
        more = [p.replace(MARK, " ") for p in self.ids if len(p) > 1]
        inside = {c for p in more for c in p}
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in inside for b in range(256)])
        self.apart = np.ones(1 << 14, bool)
        self.apart[[ord(x) << 7 | ord(y) for p in more for x, y in zip(p, p[1:], strict=False) if x < "\x80" and y < "\x80"]] = False
        self.least = min(self.scores[i] for i in self.ids.values())
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


def read(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


class Encoder:
    """Encodes sorted marked words; keeps what it has learnt of pairs of pieces."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs, self.self_made, self.known, self.older, self.bytes = v, {}, {}, {}, {}, 0
        # Lengths of the pieces that end in each three letters, longest first; a piece of two is filed under all it may follow.
        lengths: dict[str, set[int]] = {}
        for p in v.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        twos = {p for p in v.ids if len(p) == 2}
        for k in lengths:
            if k[1:] in twos:
                lengths[k].add(2)
        self.lengths = {k: tuple(sorted(n, reverse=True)) for k, n in lengths.items()}
        self.twos, self.size = twos, [len(p) for p in v.pieces]

    def outside(self, letter: str) -> list[int]:
        """Ids of a letter that isn't in the vocabulary."""
        b = self.v.bytes
        return [b[x] for x in letter.encode()] if b else [self.v.unknown]

    def merged(self, word: str) -> list[str]:
        """The pieces of a word by the merges themselves: the pair of highest score first, the leftmost of equals."""
        ids, scores = self.v.ids, self.v.scores
        part: list[str | None] = list(word)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := ids.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or right[i] != j or len(part[i]) + len(part[j]) != len(both):
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def stands(self, a: str, b: str) -> bool:
        """Whether a and b side by side stay as they are."""
        return self.merged(a + b) == [a, b]

    def whole(self, p: str) -> bool:
        known = self.self_made.get(p)
        if known is None:
            known = self.self_made[p] = self.merged(p) == [p]
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of distinct words with spaces for marks. Words met before are remembered; the new ones are one trie."""
        if len(self.known) > KNOWN // 2 or self.bytes > KNOWN_BYTES // 2:  # what isn't met again for long is forgotten, and walked again: the result is the same
            self.older, self.known, self.bytes = self.known, {}, 0
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                    self.bytes += len(w)
                else:
                    new.append((w.decode().replace(" ", MARK), w))
        new.sort()
        for (_, w), ids in zip(new, self.encode_sorted([m for m, _ in new]), strict=True):
            known[w] = ids
            self.bytes += len(w)
        return [known[w] for w in words]

    def ending(self, word: str, end: int) -> tuple[int, ...]:
        """Lengths of the pieces of two letters or more that may end there, longest first."""
        found = self.lengths.get(word[end - 3 : end]) if end > 2 else None
        return found if found is not None else (2,) if end > 1 and word[end - 2 : end] in self.twos else ()

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word, in the order given; the words are sorted, so those with a common prefix are neighbours."""
        return self._by_merges(words) if self.v.bpe else self._by_scores(words)

    def _by_merges(self, words: list[str]) -> Iterator[list[int]]:
        """The state of a prefix is the last piece of its encoding (-1: a letter outside the vocabulary)."""
        ids, size, twos, pieces = self.v.ids, self.size, self.twos, self.v.pieces
        pairs, longest_first = self.pairs, self.lengths.get
        last, before = [-1], ""
        for word in words:
            if word.startswith(MARK + MARK):
                yield [k for p in self.merged(word) for k in ([ids[p]] if p in ids else self.outside(p))]
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = -1
                if end > 2 and (three := longest_first(word[end - 3 : end])) is not None:
                    some = three
                else:
                    some = (2,) if end > 1 and word[end - 2 : end] in twos else ()
                for n in some:
                    if n > end or (k := ids.get(p := word[end - n : end])) is None:
                        continue
                    a = last[end - n]
                    if a < 0:
                        good = self.whole(p)
                    else:
                        good = pairs.get(a << 32 | k)
                        if good is None:
                            good = pairs[a << 32 | k] = self.stands(pieces[a], p)
                    if good:
                        found = k
                        break
                last.append(found if found >= 0 else ids.get(word[end - 1], -1))
            before = word
            out: list[int] = []
            end = len(word)
            while end:
                k = last[end]
                if k < 0:
                    out.extend(reversed(self.outside(word[end - 1])))
                    end -= 1
                else:
                    out.append(k)
                    end -= size[k]
            out.reverse()
            yield out

    def _by_scores(self, words: list[str]) -> Iterator[list[int]]:
        """Viterbi: the state of a prefix is its best score, and the last piece that gives it."""
        ids, scores, least = self.v.ids, self.v.scores, self.v.least
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = word[end - 1]
                k = ids.get(found)
                top = best[end - 1] + (least - 10.0 if k is None else scores[k])
                for n in self.ending(word, end):
                    if n <= end and (k := ids.get(p := word[end - n : end])) is not None and ((s := best[end - n] + scores[k]) > top or found not in ids):
                        found, top = p, s
                last.append(found)
                best.append(top)
            before = word
            out: list[int] = []
            end = len(word)
            while end:
                k = ids.get(last[end])
                out.extend(reversed(self.outside(last[end])) if k is None else [k])
                end -= len(last[end])
            out.reverse()
            yield out


def marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each, spaces for U+2581; empty texts stay empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    text = pc.replace_substring(text, MARK, " ")
    none = pa.scalar("", pa.large_string())
    return utf8(pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(none, text, pa.scalar(" ", pa.large_string()))))


def encode_batch(column: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and their offsets."""
    raw, off = marked(column)
    gap = raw == 32
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    bounds = off[:-1][np.diff(off) > 0]
    first[bounds] = True
    # No piece reaches across a letter that stands alone, so texts are cut there as well.
    alone = encoder.v.alone[raw]
    first |= alone
    first[1:] |= alone[:-1]
    ascii_ = raw < 128
    two = ascii_[1:] & ascii_[:-1]
    first[1:] |= two & encoder.v.apart[(raw[:-1].astype(np.int16) & 127) << 7 | raw[1:] & 127]
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(raw)) if len(start) else start
    _, at, which = np.unique(word_hashes(raw, start, end), return_index=True, return_inverse=True)
    size = end - start
    blob = raw.tobytes()
    if not (np.array_equal(size[at][which], size) and equal_ranges(raw, start, start[at][which], size).all()):
        # Different words with one hash: they are told apart by themselves.
        first: dict[bytes, int] = {}
        which = np.array([first.setdefault(blob[a:b], len(first)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        at = np.unique(which, return_index=True)[1]
    words = [blob[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    found = encoder.encode_words(words)
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((k for ids in found for k in ids), np.int32, int(n.sum()))
    base = np.cumsum(n) - n
    ids = flat[ranges(base[which], n[which])] if len(which) else np.zeros(0, np.int32)
    total = np.concatenate(([0], np.cumsum(n[which])))
    return ids, total[np.searchsorted(start, off)]


def decode_batch(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decoded texts, one after another, each with the space before it, and their offsets."""
    size = np.array([len(s) for s in v.surface])
    blob = np.frombuffer(b"".join(v.surface), np.uint8)
    base = np.cumsum(size) - size
    total = np.concatenate(([0], np.cumsum(size[ids])))
    return (blob[ranges(base[ids], size[ids])] if len(ids) else np.zeros(0, np.uint8)), total[off]


def decoded(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    raw, _ = decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]), v)
    return raw.tobytes().decode(errors="replace")[1:] if len(ids) else ""


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row; round_trip: the ids decode to the text."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        # Kept with the vocabulary, so a worker's next task goes on with what this one has learnt of pairs.
        encoder = v.__dict__.get("_encoder") or v.__dict__.setdefault("_encoder", Encoder(v))
        for b in batches:
            for lo, hi in slices(b.column(1), CHUNK):
                part = b.slice(lo, hi - lo)
                ids, off = encode_batch(part.column(1), encoder)
                raw, ends = decode_batch(ids, off, v)
                want, at = marked(part.column(1))
                if len(raw) == len(want) and np.array_equal(ends, at) and np.array_equal(raw, want):
                    same = np.ones(part.num_rows, bool)
                else:
                    same = np.array([np.array_equal(raw[ends[i] : ends[i + 1]], want[at[i] : at[i + 1]]) for i in range(part.num_rows)], bool)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])
            if len(encoder.pairs) > 500_000:  # keeps what is remembered of pairs bounded; they are worked out again
                encoder.pairs.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
