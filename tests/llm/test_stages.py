"""The pipeline's stages on odd rows, each against a plain version, and on no rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparklode.llm import mixing, quality_model, secrets
from sparklode.llm.store import table

ROW = "doc_id long, text string, lang string, source string, n_chars long, spans string, copies int, _row int"
WORDS = "the old bridge over the river was closed for the whole of the night because of the flood that came down from the hills".split()


def _text(k, n=60):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + (str(k) if i % 9 == 0 else "") for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [_text(k) for k in range(30)]
    texts += [texts[3], texts[3] + " and more", None, "", " \n", 'password = "hunter2hunter2" and token: abcdefgh12345678 end', "AKIA" + "A1" * 10, "deadbeef" * 5, "x" * 200_000, _text(99, 20_000)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t) if t is not None else None, "s", i, 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ROW)


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_the_fit_is_as_likely_as_a_plain_one():
    """Against plain gradient steps on dense features, with the same weights of the grades and the same penalties."""
    r = np.random.default_rng(4)
    x = (r.random((300, 5)) < 0.4).astype(float)
    y = np.digitize(x @ [2.0, -1.5, 1.0, 0.0, 0.5] + r.logistic(size=300), [-0.5, 1.0])
    owner, at = np.nonzero(x)
    ids, w, cuts = quality_model._descent(y, owner.astype(np.int32), at, np.arange(5), 500, 0.2, 1e-5, 3e-4)
    found = np.zeros(5)
    found[ids] = w
    share = np.bincount(y, minlength=3) / len(y)
    heavy = np.minimum(1 / (share * 3), 4.0)[y]

    def cost(w, c1, c2):
        s1, s2 = 1 / (1 + np.exp(c1 - x @ w)), 1 / (1 + np.exp(c2 - x @ w))
        return -(heavy * np.log(np.choose(y, [1 - s1, np.maximum(s1 - s2, 1e-12), s2]))).mean() + 1e-5 / 2 * (w**2).sum() + 3e-4 * np.abs(w).sum()

    plain = np.array([0.0, 0, 0, 0, 0, -0.5, 0.5])
    for step in range(4000):
        slope = np.array([(cost((plain + d)[:5], *(plain + d)[5:]) - cost((plain - d)[:5], *(plain - d)[5:])) / 2e-5 for d in np.eye(7) * 1e-5])
        plain -= 0.5 / (1 + step / 2000) * slope
    assert cost(found, *cuts) <= cost(plain[:5], *plain[5:]) + 1e-4
    assert np.abs(found - plain[:5]).max() < 0.05 and np.abs(cuts - plain[5:]).max() < 0.05


def test_secrets_stage(spark, odd):
    keys = secrets.automaton()

    def plain(t):
        if t is None:
            return None
        out, last = "", 0
        for s, e, _ in secrets.spans(t, keys):
            if s >= last:
                out += t[last:s] + "[SECRET]"
            last = max(last, e)
        return out + t[last:]

    got = _stage("secrets")(spark, odd, "")
    assert got.columns == odd.columns
    want = Counter((r["doc_id"], plain(r["text"]), None if r["text"] is None else len(plain(r["text"])), r["spans"], r["copies"]) for r in odd.collect())
    assert Counter((r["doc_id"], r["text"], r["n_chars"], r["spans"], r["copies"]) for r in got.collect()) == want
    assert sum("[SECRET]" in (k[1] or "") for k in want) == 3


def test_mix_stage(spark, odd):
    rows = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.allocated(rows).collect()}
    got = _stage("mix")(spark, rows, "")
    assert got.columns == rows.columns and Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in copies.items() if v})
    # Plain: the documents of a source by odds, up to its target in words.
    sized = {r["doc_id"]: r for r in mixing.allocated(rows).collect()}
    for source in {r["source"] for r in sized.values()}:
        mine = [r for r in sized.values() if r["source"] == source]
        taken, target = sum(r["copies"] * r["size"] for r in mine), mine[0]["target"]
        assert abs(taken - target) <= max(r["size"] for r in mine) and all(r["copies"] <= 2 for r in mine)
    again = _stage("mix")(spark, rows.repartition(3), "")
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in got.collect())


def test_near_copies_stage(spark, odd):
    def grams(t):
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = odd.collect()
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    sets = {i: next(grams(r["text"]) for r in rows if r["doc_id"] == i) for i in ids}
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
    got = _stage("near_copies")(spark, odd, "")
    assert got.columns == odd.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in rows if r["doc_id"] is None or low[r["doc_id"]] == r["doc_id"])


def test_quality_stage(spark, odd, data):
    got = _stage("quality")(spark, odd, data)
    assert got.columns == odd.columns
    model = quality_model.fitted(table(spark, data, "documents"), table(spark, data, "labels"))
    kept = Counter((r["doc_id"], r["kept"]) for r in quality_model.scored(odd, model).collect())
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({i: n for (i, k), n in kept.items() if k})
    empty = {k for (i, k) in kept if i in (32, 33, 34)}
    assert len(empty) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, odd, data, name):
    assert _stage(name)(spark, odd.limit(0), data).collect() == []


def test_encoding_stage(spark, odd):
    got = _stage("pieces")(spark, odd, "")
    assert got.count() == odd.count() and got.filter("NOT round_trip").count() == 0


def test_a_driver_half_full_is_eased():
    """The heap of a driver is collected after a table is written, once half of what it may take is used."""
    from types import SimpleNamespace

    from sparklode.llm import store

    for free, collected in ((100, []), (600, [])):
        java = SimpleNamespace(totalMemory=lambda: 700, freeMemory=lambda free=free: free, maxMemory=lambda: 1000, gc=lambda to=collected: to.append(1))
        store.eased(SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda java=java: java))))))
        assert len(collected) == (free == 100)
