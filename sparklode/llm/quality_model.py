"""Operator 2: quality classifier, an ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is 0 (poor), 1 (readable, but abusive) or 2 (good). One weight vector over hashed text features is
shared by all grades, and ordered thresholds cut its score: P(grade >= g) = sigmoid(score - cut[g]). The model gives the expected
grade and the tail probability P(grade = 2), by which documents are selected.

Features are marks, not counts, so that one telling word weighs the same in a long text as in a short one: hashed lower-case words and
word beginnings, hashed word shapes binned by their share of the text, and the share of words equal to the one before.

The fit reads a bounded sample of labelled rows (:data:`SAMPLE`), drawn by grade so that a rare grade is in it whole before a common one
takes its place; scoring reads every text, whole. Abuse in a language of few documents has few words that tell, so the screen of features
is wide, and a penalty on absolute weights leaves out those that add nothing.

Defined results: a null or empty text has only the bias and its shape marks; repeated rows get equal results; labels with nulls or
without a document are left out; with no label of two grades every document is kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import Tables, in_batches
from sparklode.llm.textkernel import U64, ascii_lower, mix, slices, utf8, word_hashes, words

#: Most labelled rows that the fit reads, width of the hashed space, fewest documents of the sample a feature must be in, and how many
#: standard errors its share must differ by between the grades of some pair in :data:`SIDES`. Words that tell nothing have no weight.
SAMPLE = 8_000
WIDTH = 1 << 26
LEAST_DOCS = 3
#: As many bytes at the start of a word are features by themselves.
STEMS = (5, 7)
LEAST_ERRORS = 3.0
#: Grades below and above a threshold, and neighbours alone: the many poor documents hide what tells abusive from good ones.
SIDES = (((0,), (1, 2)), ((0, 1), (2,)), ((1,), (2,)), ((0,), (1,)))
#: Tail probability from which a document is kept.
KEEP = 0.3
GRADES = 3
#: Bytes of texts worked on at once.
CHUNK = 1 << 20


@dataclass
class Model:
    ids: np.ndarray  # hashed features that have a weight, in order; some hundreds
    weights: np.ndarray
    cuts: np.ndarray  # of grades 1, 2
    bias_only: bool = False


def _shape(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of characters it has, and where."""
    n = len(raw) + 1
    seen = np.zeros((len(start), 7), bool)
    kinds = (
        (raw >= 97) & (raw <= 122) | (raw >= 128),
        (raw >= 65) & (raw <= 90),
        (raw >= 48) & (raw <= 57),
        (raw == 35) | (raw == 36) | (raw == 37) | (raw == 38) | (raw == 42) | (raw == 124) | (raw == 60) | (raw == 62),
        raw == 33,
        (raw == 46) | (raw == 44) | (raw == 59) | (raw == 58) | (raw == 63),
        (raw == 64) | (raw == 61) | (raw == 34) | (raw == 40) | (raw == 41) | (raw == 43) | (raw == 47) | (raw == 95),
    )
    total = np.zeros(n, np.int32)
    for k, mask in enumerate(kinds):
        np.cumsum(mask, out=total[1:])
        seen[:, k] = total[end] > total[start]
    return seen @ (1 << np.arange(7))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, distinct within it, and their offsets."""
    raw, off = utf8(column)
    start, end, by = words(raw, off)
    n_texts, count = len(off) - 1, np.diff(by)
    doc = np.repeat(np.arange(n_texts), count)
    shape = _shape(raw, start, end)
    # Punctuation at the end is no part of a word.
    trim = end.copy()
    for _ in range(3):
        last = raw[trim - 1] if len(trim) else trim
        cut = (trim - start > 1) & np.isin(last, np.frombuffer(b".,;:!?*$%&#", np.uint8))
        trim = trim - cut
    low = ascii_lower(raw)
    word = word_hashes(low, start, trim)
    longs = [np.flatnonzero(trim - start >= n) for n in STEMS]
    stems = [word_hashes(low, start[at], start[at] + n) ^ U64(1 << 42) for n, at in zip(STEMS, longs, strict=True)]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shares = np.zeros((n_texts, 129))
    np.add.at(shares, (doc, shape), 1)
    np.add.at(shares, (doc[same], 128), 1)
    shares /= (count + 10)[:, None]  # so that a few words don't make a style
    at, kind = np.nonzero(shares)
    level = np.minimum(np.ceil(shares[at, kind] * 8), 8).astype(np.int64)
    code = (kind * 16 + level).astype(U64) + U64(1 << 40)
    ids = (mix(np.concatenate([word, *stems, code])) % U64(WIDTH)).astype(np.int64)
    owner = np.concatenate([doc, *(doc[k] for k in longs), at])
    key = np.unique(owner * WIDTH + ids)
    return key % WIDTH, np.searchsorted(key // WIDTH, np.arange(n_texts + 1))


def sample_rows(docs: DataFrame, labels: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, grade) of at most ``bound`` labelled rows: of each grade an equal share, and what rarer grades leave of theirs, by the smallest hashes of the ids."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    given = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    counts = sorted((r["count"], r["grade"]) for r in given.groupBy("grade").count().collect())  # three rows
    few, left = given.limit(0), bound
    for k, (count, g) in enumerate(counts):
        take = min(count, left // (len(counts) - k))
        few, left = few.union(given.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take)), left - take
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "grade")


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", steps: int = 500, rate: float = 0.2, ridge: float = 1e-5, lasso: float = 3e-4) -> Model:
    """Fit on the driver, from the telling features of at most ``bound`` labelled rows; features are made, counted and chosen by executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), CHUNK):
                part = b.slice(lo, hi - lo)
                ids, off = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))), part.column(2)], ["doc_id", "ids", "grade"])

    tables = Tables(docs.sparkSession)
    made = tables.keep(sample_rows(docs, labels, bound, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, grade int"), "quality-sample")
    of = {r["grade"]: r["count"] for r in made.groupBy("grade").count().collect()}  # three rows
    if len(of) < 2:
        tables.drop_all()
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([-30.0, -30.0]), True)
    used = np.array(sorted(r["id"] for r in telling(made, of).collect()), np.int64)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, ids = b.column(1).offsets.to_numpy().astype(np.int64), b.column(1).values.to_numpy()
            at = np.searchsorted(used, ids)
            keep = used[np.minimum(at, max(len(used) - 1, 0))] == ids if len(used) else np.zeros(len(ids), bool)
            total = np.concatenate(([0], np.cumsum(keep)))
            own = np.flatnonzero(keep[off[0] : off[-1]]) + off[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((total[off] - total[off[0]]).astype(np.int32)), pa.array(at[own].astype(np.int32))), b.column(2)], ["doc_id", "at", "grade"])

    # What the driver gets: the telling features of each row of the sample, by number.
    rows = made.mapInArrow(screened, "doc_id long, at array<int>, grade int").toArrow().sort_by("doc_id")
    tables.drop_all()
    y = rows["grade"].to_numpy()
    lists = rows["at"].combine_chunks()
    at, off = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    at = at[off[0] : off[-1]]
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(off - off[0]))
    return Model(*_descent(y, owner, at, used, steps, rate, ridge, lasso))


def telling(made: DataFrame, of: dict[int, int]) -> DataFrame:
    """(id) of features in enough rows of the sample (ids, grade) whose share differs between the grades of some pair in SIDES; counted in Spark."""
    count = made.select(F.explode("ids").alias("id"), "grade").groupBy("id").agg(*(F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)))
    differs = F.lit(False)
    for below, above in SIDES:
        n_down, n_up = (float(sum(of.get(g, 0) for g in side)) for side in (below, above))
        if n_down and n_up:
            down, up = (sum((F.col(f"n{g}") for g in side[1:]), F.col(f"n{side[0]}")) for side in (below, above))
            share = (down + up) / (n_down + n_up)
            spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_up + 1 / n_down))
            differs = differs | (F.abs(up / n_up - down / n_down) >= LEAST_ERRORS * spread)
    have = sum((F.col(f"n{g}") for g in range(1, GRADES)), F.col("n0"))
    return count.filter(differs & (have >= LEAST_DOCS)).select("id")


def _descent(y: np.ndarray, owner: np.ndarray, at: np.ndarray, used: np.ndarray, steps: int, rate: float, ridge: float, lasso: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with a weight, their weights, thresholds) of the most likely model: feature ``at[k]`` is in row ``owner[k]``."""
    w, low, gap = np.zeros(len(used)), -1.0, np.log(0.5)
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    share = np.bincount(y, minlength=GRADES) / len(y)
    each = 1 / np.maximum(share * (share > 0).sum(), 1e-9)
    heavy = np.minimum(each, 4.0)[y]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        score = np.bincount(owner, w[at], len(y))
        c1, c2 = low, low + np.exp(gap)
        s1, s2 = sigmoid(score - c1), sigmoid(score - c2)
        p = np.choose(y, [1 - s1, np.maximum(s1 - s2, 1e-9), s2])
        d1, d2 = s1 * (1 - s1), s2 * (1 - s2)
        to1 = np.choose(y, [-d1, d1, 0 * d1]) / np.maximum(p, 1e-9) * heavy
        to2 = np.choose(y, [0 * d2, -d2, d2]) / np.maximum(p, 1e-9) * heavy
        g = np.concatenate([np.bincount(at, (to1 + to2)[owner], len(used)) / len(y) - ridge * w, [-(to1 + to2).mean()], [-to2.mean() * np.exp(gap)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate * (1 - step / (steps + 1)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        move = pace * (m / (1 - 0.9**step))
        w, low, gap = w + move[:-2], low + move[-2], gap + move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - lasso * pace[:-2], 0)
    return used[w != 0].astype(np.int64), w[w != 0], np.array([low, low + np.exp(gap)])


def scored(docs: DataFrame, model: Model, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one weight a telling feature of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for lo, hi in slices(b.column(1), CHUNK):
                part = b.slice(lo, hi - lo)
                tail, expected = probabilities(part.column(1), m)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= keep)], ["doc_id", "expected_grade", "tail_prob", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double, kept boolean")


def probabilities(column: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    ids, off = features(column)
    at = np.minimum(np.searchsorted(m.ids, ids), max(len(m.ids) - 1, 0))
    each = np.where(m.ids[at] == ids, m.weights[at], 0.0) if len(m.ids) else np.zeros(len(ids))
    total = np.concatenate(([0.0], np.cumsum(each)))
    score = np.round(total[off[1:]] - total[off[:-1]], 6)
    s = 1 / (1 + np.exp(-np.clip(score[:, None] - m.cuts[None], -40, 40)))
    return s[:, 1], s.sum(axis=1)


def selected(docs: DataFrame, model: Model, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their columns as they are; no exchange."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            for lo, hi in slices(text, CHUNK):
                yield b.slice(lo, hi - lo).filter(pa.array(probabilities(text.slice(lo, hi - lo), held.value)[0] >= keep))

    return in_batches(docs).mapInArrow(run, docs.schema)
