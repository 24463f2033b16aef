import numpy as np
import pytest

from sparklode.llm import repeats as R


def _texts():
    r = np.random.default_rng(1)
    base = [bytes(r.integers(97, 101, 3000, dtype=np.uint8)) for _ in range(3)]
    out = []
    for i in range(24):
        b = bytearray(base[i % 3][: int(r.integers(500, 3000))])
        for _ in range(int(r.integers(0, 4))):
            b[int(r.integers(len(b)))] = 120
        out.append(bytes(b))
    return [*out, b"ab" * 700, b"ab" * 250 + b"c" + b"ab" * 300, b"", b"x" * 399, b"q" * 400, b"z" * 401, base[0], "é".encode() * 300 + b"tail" * 10]


def _compare(spark, texts):
    df = spark.createDataFrame([(i, t.decode() if t is not None else None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r["doc_id"]: r for r in R.digest(R.cleaned(df)).collect()}
    want = R.brute([t or b"" for t in texts])
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i
        assert got[i]["n_bytes"] == len(texts[i] or b"")
    return want


def test_against_all_passages(spark):
    assert sum(w[0] for w in _compare(spark, [*_texts(), None])) > 10_000


def test_long_texts_are_cut_and_rejoined(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 700)
    raw = np.frombuffer(b"".join(_texts()[:3]) * 2, np.uint8)
    whole = R.key_runs(raw, np.array([0, len(raw)]))
    parts = list(R._parts(raw, np.array([0, len(raw)]), R.LENGTH, R.GRAM))
    assert len(parts) > 1 and sum(int(p[3].sum()) for p in parts) == int(whole[3].sum()) == len(raw) - R.LENGTH + 1
    assert {(int(k), int(a)) for p in parts for k, a in zip(p[1], p[2], strict=True)} >= {(int(k), int(a)) for k, a in zip(whole[1], whole[2], strict=True)}


def alike_in_part(seed, n=1200):
    """Texts put together from few passages of a common stock, with changes; many occurrences end a piece."""
    r = np.random.default_rng(seed)
    stock = [bytes(r.integers(97, 123, int(r.integers(380, 900)), dtype=np.uint8)) for _ in range(60)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(r.integers(1, 4))):
            x = stock[int(r.integers(len(stock)))]
            a = int(r.integers(0, 60))
            parts.append(x[a : len(x) - int(r.integers(0, 60))] if r.random() < 0.7 else bytes(r.integers(97, 123, 300, dtype=np.uint8)))
        b = bytearray(b"".join(parts))
        if r.random() < 0.3:
            b[int(r.integers(len(b)))] = 48
        out.append(bytes(b))
    return out


@pytest.mark.parametrize("hot,size", [(8192, 32 << 20), (3, 32 << 20), (8192, 5000)])
def test_texts_alike_in_part(spark, monkeypatch, hot, size):
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "HOT_BYTES", size)
    assert sum(w[0] for w in _compare(spark, alike_in_part(4, 1200 if hot > 3 and size > 5000 else 150))) > 10_000


@pytest.mark.parametrize("seed", range(8))
def test_repeated_starts_are_all_found(seed):
    texts = alike_in_part(seed, 40)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got, piece = R.repeated_starts(raw, off, np.maximum(np.diff(off) - 399, 0), np.arange(len(texts)) % 4)
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], []).append((int(off[k]) + i, k))
    assert sorted(zip(got.tolist(), piece.tolist(), strict=True)) == sorted(x for v in seen.values() if len(v) > 1 for x in v)


def test_the_merged_transforms_decide(monkeypatch):
    """Without common prefixes between the merged suffixes only passages without a whole phrase are found."""
    texts = alike_in_part(3, 40)
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    ask = (raw, off, np.maximum(np.diff(off) - 399, 0), np.arange(len(texts)) % 4)
    whole = len(R.repeated_starts(*ask)[0])
    plain = R.interleaved
    monkeypatch.setattr(R, "interleaved", lambda t, d: (lambda p, c: (p, np.minimum(c, 0)))(*plain(t, d)))
    assert len(R.repeated_starts(*ask)[0]) < whole / 2


def test_passages_with_one_hash():
    """Texts that collide modulo 2**64 in every base aren't taken for copies."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048)).encode()
    raw = np.frombuffer(one + one.translate(bytes.maketrans(b"ab", b"ba")) + one, np.uint8)
    assert R.twice_there(raw, np.array([0, 2048, 4096]), 2048).tolist() == [0, 2]


def test_null_ids_repeated_rows_and_ids_with_two_texts(spark):
    r = np.random.default_rng(2)
    a, b, c = (bytes(r.integers(97, 123, 700, dtype=np.uint8)).decode() for _ in range(3))
    rows = [(None, "x" + a), (None, "y" + a[50:]), (5, b), (5, b), (6, c[:500]), (6, a[:420] + "z"), (7, c), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in R.digest(R.cleaned(df)).collect())
    assert got == sorted((str(k), *w) for (k, _), w in zip(rows, R.brute([(t or "").encode() for _, t in rows]), strict=True))


def test_empty_table(spark):
    assert R.digest(R.cleaned(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_merge_orders_suffixes(shards):
    r = np.random.default_rng(shards)
    every = [np.append(r.integers(1, 4, 40), 0) for _ in range(shards)]
    orders, transforms = zip(*(R.transform(s, 64) for s in every), strict=True)
    place, common = R.interleaved(list(transforms), 64)
    starts = [(k, int(i)) for k, o in enumerate(orders) for i in o]
    cyclic = lambda k, i: tuple(np.roll(every[k], -i)) * 2
    merged = [cyclic(*starts[p]) for p in place]
    # Up to the end mark the order is that of the suffixes.
    cut = [m[: m.index(0) + 1] for m in merged]
    assert cut == sorted(cut)
    for a, b, c in zip(cut, cut[1:], common[1:-1], strict=False):
        lcp = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c >= lcp if a == b else c == lcp


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    assert R.sliding_min(x, 7).tolist() == [int(x[i : i + 7].min()) for i in range(44)]
