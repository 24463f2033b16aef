"""Operator 6: removing repeated passages, by merging Burrows-Wheeler transforms of shards.

A passage is a string of :data:`LENGTH` bytes; every byte of a passage that starts in two places or more is removed.

1.  *Runs.* Each start of a passage is filed under the least hash among its passage's :data:`GRAM`-byte grams. Equal passages have
    equal keys, and starts next to each other mostly share one, so a text becomes a few runs of starts, each with a key and
    a 128-bit digest of the bytes that its passages cover. No exchange of text.
2.  *Copies.* Runs are counted by key and digest, in Spark. A key met once is dropped: its passages are unique. Runs of equal
    bytes are repeated whole. Only keys with different bytes (texts that are alike in part) and runs that overlap themselves go on,
    one representative for each different byte string.
3.  *Shards.* The representatives' bytes are cut into phrases at places that the content names. Each shard's phrase sequences are
    suffix-sorted once, which gives its Burrows-Wheeler transform.
4.  *Merge.* The transforms are merged by iterative interleave refinement: an interleaving of the shards, right for the first h
    symbols of all suffixes, is made right for h + 1 by one stable distribution by the transforms' symbols. The round in which two
    neighbours part is their common prefix. Suffixes aren't sorted again. A passage's whole phrases are repeated where they lie in an
    interval of the merged order whose common prefix is as long as they are many: starts outside such intervals are dropped, and those
    of one interval meet.
5.  *Bytes.* Before and after its whole phrases a passage has some bytes left: starts of an interval are told apart by them. An exact
    comparison follows, byte by byte.

A task holds whole keys, some megabytes at a time. A key of more than :data:`HOT` different byte strings, or :data:`HOT_BYTES` bytes of them,
would not fit: its starts are dealt out one by one, by a 128-bit digest of each passage, and counted in Spark.

Defined results: null and empty texts have no bytes; texts shorter than a passage lose nothing; matches don't cross documents; every row is
a document of its own, so repeated rows are copies of one another, and an id with two texts has a row for each; rows without an id take
part; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.bits import bit_table, maybe_in
from sparklode.llm.store import in_batches, Tables
from sparklode.llm.textkernel import U64, Rolling, equal_ranges, mix, ranges, slices, utf8

LENGTH = 400
GRAM = 96
#: Bytes of texts worked on at once, in the first pass and in a merge. Longer texts are worked on in parts that overlap by a passage.
CHUNK = 1 << 20
#: A phrase ends where the hash of the CUT bytes before is a multiple of EACH.
CUT, EACH = 16, 32
SHARDS = 4
#: Different byte strings of a key that one task takes at most.
HOT, HOT_BYTES = 8192, 32 << 20


def digest_of(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i; by block minima from both ends."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def key_runs(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, key, first start in the text, number of starts, digest of the bytes, whether it may overlap itself) of each run."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(U64), none, none, [], none.astype(bool)
    roll, w = Rolling(raw), length - gram + 1
    grams = roll.grams(gram)
    least = sliding_min(grams, w)
    size = np.diff(off)
    starts = np.maximum(size - length + 1, 0)
    at = ranges(off[:-1], starts)
    text = np.repeat(np.arange(len(size)), starts)
    key = least[at]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))) if len(at) else none
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    # Equal passages of one run lie on each other shifted, so that its key's gram is there twice, near by.
    again = count > w
    edge = np.full(w - 1, np.iinfo(U64).max, U64)
    most = ~sliding_min(~np.concatenate([~edge, least, ~edge]), w)  # of each gram: the largest least it is in the reach of
    chosen = np.flatnonzero(grams == most[: len(grams)])
    twin = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= w))
    if len(twin) and len(begin):
        left, right = chosen[twin], chosen[twin + 1]
        lo = np.maximum(np.searchsorted(begin, right - w + 1, side="right") - 1, 0)
        hi = np.maximum(np.searchsorted(begin, left, side="right") - 1, lo)
        run = ranges(lo, hi - lo + 1)
        of = np.repeat(grams[left], hi - lo + 1)
        again[run[key[first][run] == of]] = True
    again &= count > 1
    data = memoryview(raw.tobytes())
    covered = [digest_of(data[a:b]) for a, b in zip(begin.tolist(), (begin + count - 1 + length).tolist(), strict=True)]
    return text[first], key[first], begin - off[text[first]], count, covered, again


def _parts(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`key_runs` of texts; of a long text part by part (a run that is cut in two only has its key twice)."""
    if len(raw) <= 2 * CHUNK or len(off) > 2:
        yield key_runs(raw, off, length, gram)
        return
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        text, key, begin, *rest = key_runs(part, np.array([0, len(part)]), length, gram)
        yield text, key, begin + at, *rest


def runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), CHUNK):
                part = b.slice(lo, hi - lo)
                for text, key, at, count, ph, again in _parts(*utf8(part.column(1)), length, gram):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(i).take(pa.array(text, pa.int64())) for i in (0, 2)),
                            *(pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32))),
                            *(pa.array(ph, pa.binary()), pa.array(again)),
                        ],
                        ["doc_id", "text_id", "key", "at", "n", "bytes", "again"],
                    )

    return in_batches(texts).mapInArrow(run, "doc_id long, text_id long, key long, at int, n int, bytes binary, again boolean")


# ---------------------------------------------------------------- transforms and their merge


def phrases(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of each piece (positions, and their range by piece), and the hash of the phrase from each cut to the next (0: none)."""
    roll = Rolling(raw)
    mark = np.zeros(len(raw) + 1, bool)
    g = roll.grams(CUT)
    mark[CUT : CUT + len(g)] = g % U64(EACH) == 0
    piece = np.repeat(np.arange(len(off) - 1), np.diff(off))
    cuts = np.flatnonzero(mark[:-1]) if len(raw) else np.zeros(0, np.int64)
    cuts = cuts[cuts - off[piece[cuts]] >= CUT]
    by = np.searchsorted(cuts, off)
    symbol = np.zeros(len(cuts), U64)
    if len(cuts) > 1:
        inner = np.flatnonzero(piece[cuts[1:]] == piece[cuts[:-1]])
        symbol[inner] = roll.spans(cuts[inner], cuts[inner + 1]) | U64(1)
    return cuts, by, symbol


def suffix_order(symbol: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a symbol sequence ordered by their first ``depth`` symbols, by prefix doubling; 0 ends a piece."""
    rank, h, n = symbol.astype(np.int64), 1, len(symbol)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = rank[h:] + 1
        order = np.lexsort((after, rank))
        new = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h *= 2
        if h >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order


def transform(symbol: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform (the symbol before each suffix) of a shard."""
    order = suffix_order(symbol, depth)
    return order, symbol[order - 1]


def interleaved(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge of transforms: for each place of the merged order its place in the transforms laid end to end, and its common prefix with the place before.

    ``source`` is the interleaving. In a round every suffix is put, in the present order, after those with a smaller symbol before
    them: that orders the suffixes one symbol longer. Rounds end when no block of equal prefixes has split.
    """
    every = np.concatenate(transforms)
    n = len(every)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) < 256 else np.int32), [len(t) for t in transforms])
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    block = np.zeros(n, np.int32)
    place = np.arange(n)
    for h in range(depth):
        char = every[place]
        to = np.argsort(char, kind="stable")
        c, b = char[to], block[to]
        edge = np.concatenate(([True], (c[1:] != c[:-1]) | (b[1:] != b[:-1])))
        fresh = edge & (common[:n] < 0)
        common[np.flatnonzero(fresh)] = h
        moved = source[to]
        same = np.array_equal(moved, source)
        source = moved
        block = np.cumsum(edge, dtype=np.int32)
        order = np.argsort(source, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        if h and same and not fresh.any() or block[-1] == n:
            break
    common[common < 0] = depth
    return place, common


def repeated_starts(raw: np.ndarray, off: np.ndarray, count: np.ndarray, shard: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces laid end to end (piece i covers ``count[i]`` starts): the starts, as positions, whose passage is there twice; and their pieces."""
    cuts, by, symbol = phrases(raw, off)
    piece = np.repeat(np.arange(len(count)), count)
    start = ranges(off[:-1], count)
    before = np.zeros(len(raw) + 2, np.int64)
    np.add.at(before, cuts + 1, 1)
    before = np.cumsum(before)  # cuts before each position
    head = before[start + CUT]
    # Whole phrases of the passage. A cut at its very end is left out: where a piece ends there, it isn't seen.
    inside = before[start + length] - head - 1
    candidate = inside <= 0
    if len(symbol):
        depth = int(max(inside.max(initial=0), 0)) + 2
        _, dense = np.unique(symbol, return_inverse=True)
        dense = dense.astype(np.int64) + 1
        dense[symbol == 0] = 0
        owner = np.repeat(np.arange(len(count)), np.diff(by))
        orders, transforms = [], []
        for s in np.unique(shard):
            own = np.flatnonzero(shard[owner] == s)
            if len(own):
                order, bwt = transform(dense[own], depth)
                orders.append(own[order])
                transforms.append(bwt)
        place, common = interleaved(transforms, depth)
        suffix = np.concatenate(orders)[place]
        deep, rank = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
        deep[suffix], rank[suffix] = np.maximum(common[:-1], common[1:]), np.arange(len(suffix))
        some = np.flatnonzero(~candidate)
        candidate[some] = deep[head[some]] >= inside[some]
    start, piece, head, inside = start[candidate], piece[candidate], head[candidate], inside[candidate]
    # Equal passages: one repeated interval of whole phrases, and equal bytes before and after these.
    roll, key = Rolling(raw), np.zeros(len(start), U64)
    short = np.flatnonzero(inside <= 0)
    key[short] = roll.spans(start[short], start[short] + length)
    for d in np.unique(inside[inside > 0]).tolist():
        mine = np.flatnonzero(inside == d)
        interval = np.cumsum(common[:-1] < d)[rank[head[mine]]].astype(U64)
        left, right = roll.spans(start[mine], cuts[head[mine]]), roll.spans(cuts[head[mine] + d], start[mine] + length)
        key[mine] = mix(mix(mix(interval * U64(2) + U64(1)) + left) + right * U64(3) + U64(d))
    found = twice_there(raw, start, length, key)
    return start[found], piece[found]


def twice_there(raw: np.ndarray, start: np.ndarray, length: int, key: np.ndarray | None = None) -> np.ndarray:
    """Which of the starts, in order, have a passage that another of them has as well: those of one ``key`` (a hash of the passage, if none is given), compared byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64)
    h = Rolling(raw).spans(start, start + length) if key is None else key
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    # Each start's partner: the one before it with its hash, or the one after for the first.
    partner = np.full(len(start), -1)
    partner[order[:-1][same]] = order[1:][same]
    partner[order[1:][same]] = order[:-1][same]
    some = np.flatnonzero(partner >= 0)
    if not len(some):
        return some
    at, to = start[some], start[partner[some]]
    # Starts next to each other with partners next to each other are compared as one range.
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    good = equal_ranges(raw, at[first], to[first], at[last] - at[first] + length)
    right = np.repeat(good, last - first + 1)
    if right.all():
        return some
    # Hashes that different passages share: told apart by the passages themselves.
    wrong = np.unique(h[some[~right]])
    doubt = np.isin(h, wrong)
    data, seen = raw.tobytes(), {}
    for i in np.flatnonzero(doubt).tolist():
        seen.setdefault(data[start[i] : start[i] + length], []).append(i)
    clear = some[right & ~doubt[some]]
    return np.sort(np.concatenate([clear, *(np.array(x) for x in seen.values() if len(x) > 1)])).astype(np.int64)


def merged(pieces: DataFrame, length: int) -> DataFrame:
    """(key, bytes, from, to): ranges of starts, in the piece, whose passages are there twice; pieces come sorted by key."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        key, ph, n, shard, data = (list(c) for c in zip(*rows, strict=True))
        raw = np.frombuffer(b"".join(data), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        at, piece = repeated_starts(raw, off, np.array(n, np.int64), np.array(shard), length)
        at = at - off[piece]
        first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])))[: len(at)]
        lo = np.flatnonzero(first)
        hi = np.append(lo[1:], len(at))
        own = piece[lo]
        return pa.RecordBatch.from_arrays([pa.array(np.array(key, np.int64)[own]), pa.array([ph[i] for i in own.tolist()], pa.binary()), pa.array(at[lo].astype(np.int32)), pa.array((at[hi - 1] + 1).astype(np.int32)) if len(lo) else pa.array([], pa.int32())], ["key", "bytes", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != last and size >= CHUNK:
                    yield work(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield work(held)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, bytes binary, from int, to int")


def starts_counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for keys of any number of pieces: every start by itself, by the digest of its passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, ph, n, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                passages = [digest_of(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([ph] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(passages, pa.binary())], ["key", "bytes", "from", "passage"])

    starts = pieces.mapInArrow(run, "key long, bytes binary, from int, passage binary")
    twice = starts.groupBy("passage").agg(F.count("*").alias("met")).filter("met > 1").select("passage")
    return starts.join(twice, "passage").select("key", "bytes", "from", (F.col("from") + 1).alias("to"))


def ranges_to_remove(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_id, from, to): byte ranges to remove, not yet joined; ``texts`` has (doc_id, text, text_id)."""
    tables = Tables(texts.sparkSession)
    every = tables.keep(runs(texts, length, gram), "repeat-runs")
    kinds = every.groupBy("key", "bytes").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_id", "at", "n", "again")).alias("one"))
    kinds = tables.keep(kinds, "repeat-kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("total"), F.max("one.again").alias("again"), F.sum(F.col("one.n") + length).alias("size")).filter((F.col("total") > 1) | F.col("again"))
    live = tables.keep(kinds.join(keys.drop("again"), "key").select("key", "bytes", "copies", "different", "size", "one.*"), "repeat-live")
    tables.drop(kinds)
    whole = live.filter("copies > 1").select("key", "bytes", F.lit(0).alias("from"), F.col("n").alias("to"))
    ask = live.filter("different > 1 OR again").select("doc_id", "text_id", "key", "bytes", "at", "n", ((F.col("different") > HOT) | (F.col("size") > HOT_BYTES)).alias("hot"))
    wanted = bit_table(ask.select("doc_id"))
    lists = ask.groupBy(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).agg(F.collect_list(F.struct("key", "bytes", "at", "n", "hot")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, text_id, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = (text or "").encode()
                for r in found:
                    piece = data[r["at"] : r["at"] + r["n"] - 1 + length]
                    for o, v in zip(out, (r["key"], r["bytes"], r["n"], text_id % SHARDS, piece, r["hot"]), strict=True):
                        o.append(v)
                if len(out[0]) > 4096:
                    yield _pieces(out)
                    out = [[] for _ in range(6)]
            yield _pieces(out)

    one = maybe_in(texts, "doc_id", wanted)
    # A row that is there twice is one representative.
    one = one.join(lists, one["doc_id"].eqNullSafe(lists["_d"]) & (one["text_id"] == lists["_t"])).select("doc_id", "text", "text_id", "runs")
    pieces = tables.keep(one.mapInArrow(cut, "key long, bytes binary, n int, shard int, data binary, hot boolean"), "repeat-pieces")
    cold, hot = pieces.filter("NOT hot").drop("hot"), pieces.filter("hot").drop("hot").dropDuplicates(["key", "bytes"])
    part = merged(cold, length).unionByName(starts_counted(hot, length))
    both = tables.keep(whole.unionByName(part), "repeat-ranges")
    tables.drop(pieces)
    hit = every.select("doc_id", "text_id", "key", "bytes", "at").join(both, ["key", "bytes"])
    hits = Tables(texts.sparkSession).keep(hit.select("doc_id", "text_id", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to") - 1 + length).alias("to")).distinct(), "repeat-hits")
    tables.drop_all()
    return hits


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["key", "bytes", "n", "shard", "data", "hot"])


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row; ``kept`` is what is left of the text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_id"))
    hits = ranges_to_remove(texts, length, gram)
    by_doc = hits.groupBy(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    wanted = bit_table(hits.select("doc_id"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, kept = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                cut = joined([(r["from"], r["to"]) for r in found or ()])
                size.append(len(data))
                removed.append(sum(e - s for s, e in cut))
                spans.append(len(cut))
                at = [0, *(x for c in cut for x in c), len(data)]
                kept.append(b"".join(data[s:e] for s, e in zip(at[::2], at[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    some = maybe_in(texts, "doc_id", wanted)
    some = some.join(by_doc, some["doc_id"].eqNullSafe(by_doc["_d"]) & (some["text_id"] == by_doc["_t"]), "left")
    touched = some.select("doc_id", "text", "ranges").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    body = F.coalesce("text", F.lit("")).cast("binary")
    rest = maybe_in(texts, "doc_id", wanted, inside=False).select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), body.alias("kept"))
    return touched.unionByName(rest)


def digest(clean: DataFrame) -> DataFrame:
    """Counts, the digest of what is left, and what is left as text (a letter that is cut in two gives U+FFFD)."""
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) by a table of all passages; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cut = joined([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        at = [0, *(x for c in cut for x in c), len(t)]
        out.append((sum(e - s for s, e in cut), len(cut), hashlib.sha256(b"".join(t[s:e] for s, e in zip(at[::2], at[1::2], strict=True))).hexdigest()))
    return out
