"""Numpy kernels over the UTF-8 bytes of an Arrow string column.

Everything here works on a whole batch of texts at once: no Python loop over characters or words.
White space is ``\\x20`` and ``\\x09-\\x0D``; these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i mod 2**64`` for i < n; kept for the life of the process."""
    p = _POW.get(base)
    if p is None or len(p) < n:
        size = -(-n // (1 << 18)) << 18
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        _POW[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, so that what is worked on at once has a bound; a longer text is a range of its own."""
    _, off = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b
        a = b


def space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and words[i]..words[i + 1] of text i (as offsets into the words)."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not(space(raw), out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    bounds = off[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]
    first[bounds] = inside[bounds]
    last = inside[:n] & ~inside[1:]
    if n:
        last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


#: Ranges over this many bytes are hashed one by one.
LONG = 256


def blocks_of(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one little-endian number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))


def _tail(left: np.ndarray) -> np.ndarray:
    """Masks of the bytes that belong to a range of which ``left`` bytes are left."""
    return np.where(left >= 8, ~U64(0), (U64(1) << (U64(8) * np.minimum(left, 7).astype(U64))) - U64(1))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, each a chain of non-linear steps over eight bytes; long ones by BLAKE2b.

    Unlike a polynomial modulo a power of two, no two fixed texts are known to collide; chance is 2**-64 a pair.
    """
    size = end - start
    h = mix(size.astype(U64) + U64(_B))
    block = blocks_of(raw)
    at = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(at):
        h[at] = mix((h[at] ^ (block[start[at] + done] & _tail(size[at] - done))) + U64(_B))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def equal_ranges(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes from a and from b hold the same bytes, compared byte by byte."""
    block = blocks_of(raw)
    same = np.ones(len(a), bool)
    at, done = np.flatnonzero((size > 0) & (a != b)), 0
    while len(at):
        differ = (block[a[at] + done] ^ block[b[at] + done]) & _tail(size[at] - done)
        same[at[differ != 0]] = False
        done += 8
        at = at[(differ == 0) & (size[at] > done)]
    return same


class Rolling:
    """Polynomial hashes mod 2**64 of any byte range of ``raw``: for keys only, since texts that collide are known."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, U64)
        terms = powers(_B, n) * (raw.astype(U64) + U64(1))
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(_INV, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each range; ranges of equal bytes have equal hashes wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of the k bytes from each position (n - k + 1 of them)."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.back[: n - k + 1])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., start[1], ...: all positions of the given ranges, one after another."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of ASCII-lower-cased texts, and their offsets; a text of 1 to k-1 words has one, of all its words."""
    start, end, by = words(raw, off)
    h = word_hashes(ascii_lower(raw), start, end)
    count = np.diff(by)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = ranges(by[:-1], n)
    size = np.repeat(np.minimum(count, k), n)
    out = np.zeros(len(at), U64)
    for j in range(k):
        more = size > j
        if more.all():
            out = mix(out * U64(0x100000001B3) + h[at + j] + U64(j + 1))
        else:
            out[more] = mix(out[more] * U64(0x100000001B3) + h[at[more] + j] + U64(j + 1))
    return out, np.concatenate([[0], np.cumsum(n)])
