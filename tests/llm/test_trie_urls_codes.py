"""The prefix trie, URL filters and vector codes against plain versions on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.llm import prefix_trie, url_rules, vector_codes

TURN = "conv_id long, turn long, role string, text string"


def _trie(rows):
    said = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said[c].append(((t is not None, t or 0), role or "", text or ""))
    said = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = said.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n for m in members if m) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ended = ",".join(str(c) for c in who if len(built[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(kids), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def _found(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[:2])


def test_trie(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["u", None]), rnd.choice(["x", "é" * 3, None])) for c in range(40) if c != 25 for t in [*range(rnd.choice([1, 2, 11])), *[None] * rnd.choice([0, 1])]]
    rows += [(41, t, "u", "l" * (t % 3)) for t in range(60)] + [(None, 1, "u", "x")] + [(50 + i, 0, "u", "same") for i in range(50)]
    frame = spark.createDataFrame(rows, TURN).withColumns({"k1": F.lit(1), "depth": F.lit("x"), "_piece": F.lit(0)})
    assert _found(prefix_trie.trie(frame.repartition(3))) == _trie(rows)


def test_trie_deals_long_conversations_and_common_prefixes(spark):
    """Over many pieces: a conversation of a third of the rows, and as many conversations of one turn; no piece holds either."""
    rows = [(1, t, "u", str(t % 7)) for t in range(400)] + [(100 + i, 0, "u", "same") for i in range(400)] + [(1000 + i, t, "u", str(i)) for i in range(100) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        frame = spark.createDataFrame(rows, TURN)
        assert _found(prefix_trie.trie(frame)) == _trie(rows)
        tables = prefix_trie.Tables(spark)
        order = prefix_trie.Pieces(prefix_trie.turns(frame), ["conv_id"], [F.col("turn")], lambda d: tables.keep(d, "trie-test"))
        assert max(r["count"] for r in order.rows.groupBy("_piece").count().collect()) < 400
        tables.drop_all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing_and_of_repeats(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURN)).collect() == []
    rows = [(9, 0, "u", "a")] * 3 + [(9, None, None, None), (4, 0, None, None)]
    assert _found(prefix_trie.trie(spark.createDataFrame(rows, TURN))) == _trie(rows)


def _host_path(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for sign in "/?#":
        host = host.split(sign, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def _rule(host, path):
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x", "a://example.org", "a://example.org?x=/es/", "a://notexample.org/es/", "a://x.example.org/en/123#/es/", "b://com/de/", "b://COM/fr/?q", "b://xcom/fr/", "c://É.Com/de/1", "d://a/b://c/", "e://u@h:80/p", "f://" + "long." * 3000 + "net/" + "p/" * 3000, "g://..//../", "h://example.org/ES/"]


def test_urls_by_rule(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)] + [(0, None, "x"), (None, "b://com/de/", "y")], "page_id long, url string, host string")
    known = spark.createDataFrame([], "url string, label string")
    got = url_rules.judged(pages, known).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        url = "b://com/de/" if r["page_id"] is None else ODD[r["page_id"]]
        host, path = _host_path(url)
        rule = _rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["by_tokens"]) == (host, path, rule and rule.text, rule.verdict if rule else "allow", "allow"), url
    assert url_rules.judged(pages.limit(0), known).collect() == []


def _tokens(url):
    host, path = _host_path(url)
    names, words = host.split("."), [w for w in "".join(x if x not in "/._-" else " " for x in "".join(c.lower() if c.isascii() else c for c in path)).split(" ") if w]
    query = url.split("#")[0].partition("?")[2] if url else ""
    out = ["tld:" + names[-1]] if host else []
    out += ["host:" + n for n in names[:-1] if n] + ["path:#" if w.isdigit() else "path:" + w for w in words] + ["query:" + k.split("=")[0] for k in query.split("&") if k]
    return sorted(set(out))


def _mined(known, support, confidence):
    bags = [(t, label) for t, label in ((_tokens(u), label) for u, label in known) if len(t) <= url_rules.MOST_TOKENS]
    one, both = Counter(), Counter()
    for t, label in bags:
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                one[c] += 1
                both[c, label] += 1
    least = max(ceil(support * len(bags)), url_rules.MIN_ROWS)
    rules = {(c, label): (n / one[c], n / len(bags)) for (c, label), n in both.items() if n >= least and n / one[c] >= confidence}
    return {(c, label): v for (c, label), v in rules.items() if not any((c[:i] + c[i + 1 :], label) in rules and rules[c[:i] + c[i + 1 :], label][0] >= v[0] for i in range(len(c)))}


def test_urls_by_mined_rules(spark):
    """Planted: hosts of "pills" are blocked but under /safe/, and so is /win/ on net; the rest is mixed or allowed."""
    rnd = random.Random(3)
    made = []
    for i in range(240):
        host, top, kind = rnd.choice(["pills", "news", "blog-a"]), rnd.choice(["net", "edu"]), rnd.choice(["safe", "win", "a"])
        bad = host == "pills" and kind != "safe" or kind == "win" and top == "net" or i % 29 == 0
        made.append((f"http://{host}.site.{top}/{kind}/{i}", "block" if bad else "allow"))
    known, rest = made[:160], made[160:]
    frame = spark.createDataFrame(known, "url string, label string")
    want = _mined(known, 0.01, 0.5)
    got = {(tuple(r["tokens"]), r["label"]): (r["confidence"], r["support"]) for r in url_rules.mined(frame).collect()}
    assert got == want and got
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(rest)] + [(900, rest[0][0], "x")], "page_id long, url string, verdict string")
    verdicts = {}
    for r in url_rules.judged(pages, frame).collect():
        t = set(_tokens(rest[r["page_id"] % 900][0]))
        fit = [(*v, len(c), label) for (c, label), v in want.items() if t >= set(c)]
        assert r["by_tokens"] == (max(fit)[-1] if fit else "allow")
        verdicts[r["page_id"]] = r["verdict"]
    assert len(verdicts) == len(rest) + 1
    right = sum(verdicts[i] == label for i, (_, label) in enumerate(rest))
    assert right >= 0.9 * len(rest)  # held-out URLs; "allow" for all would give about half


def test_url_plan_is_native(spark, data):
    from sparklode.llm.queries import queries

    plan = queries()["op12_url_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _codes(rows):
    whole = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0], r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    if not whole:
        return {}, None
    w = -(-len(whole[0][1]) // 4)
    x = [[[*(floor(1024 * float(np.float32(c))) for c in v), *[0] * (4 * w - len(v))][p * w : p * w + w] for p in range(4)] for _, v, _ in whole]
    books = [[x[k][p] for k in range(min(256, len(x)))] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for v in x]

    for _ in range(4):
        for p in range(4):
            at = assign(p)
            for k in range(len(books[p])):
                mine = [x[i][p] for i, (_, e) in enumerate(at) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [assign(p) for p in range(4)]
    total = Counter()
    coded = []
    for i, (vec_id, _, label) in enumerate(whole):
        error = sum(found[p][i][0] for p in range(4))
        total[label] += error
        coded.append((vec_id, "".join(f"{found[p][i][1]:02x}" for p in range(4)), error, label))
    mark = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, code, min(e, 2**63 - 1), min(total[label], 2**63 - 1)) for i, code, e, label in coded), mark


VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("scale,length", [(1.0, 8), (3000.0, 8), (1e9, 6)])
def test_codes(spark, scale, length):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) * scale for _ in range(length)], rnd.choice([1, 2, None])) for i in range(300)]
    rows += [(400, None, 1), (-5, [None] * length, 2), (401, [float("nan")] * length, 2), (402, [float("inf")] + [0.0] * (length - 1), 1), (403, [1.0], 1), (404, [], 1)]
    rows += [(405, [0.0] * length, None)] * 40 + [(7, rows[7][1], 2)] * 3
    frame = spark.createDataFrame(rows, VEC).withColumns({"code": F.lit("x"), "_label": F.lit(3)})
    want, mark = _codes(rows)
    got = vector_codes.compressed(frame.repartition(4)).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {mark}


def test_codes_of_nothing_and_of_few(spark):
    assert vector_codes.compressed(spark.createDataFrame([], VEC)).collect() == []
    rows = [(3, [0.5, -0.5, 0.25, 1.0], None), (1, [0.5, -0.5, 0.25, 1.0], None)]
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compressed(spark.createDataFrame(rows, VEC)).orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (3, "00000000", 0, 0)]


def test_annulus_is_exact_and_leaves_entries_out(monkeypatch):
    """Equal distances, entries of equal norm and of norms far apart; the annulus saves most of the entries where norms differ."""
    rnd = np.random.default_rng(0)
    seen = []
    plain = vector_codes.Codebook._evaluated
    monkeypatch.setattr(vector_codes.Codebook, "_evaluated", lambda self, rows, s, e, a, b: (seen.append(len(rows) * (b - a)), plain(self, rows, s, e, a, b))[1])
    for spread in (3, 400, 10**5):
        entries = rnd.integers(-spread, spread + 1, (256, 3)) * rnd.integers(1, 30, (256, 1))
        rows = rnd.integers(-spread, spread + 1, (2000, 3)) * rnd.integers(1, 30, (2000, 1))
        d = ((rows[:, None] - entries[None]) ** 2).sum(-1)
        seen.clear()
        index, best = vector_codes.Codebook(entries).nearest(rows)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert sum(seen) < 0.7 * d.size


def test_urls_of_many_tokens_are_mined(spark):
    """Each of these URLs has over 30 tokens: a long path that they share, and one word that tells. Left out of mining, all would be "allow"."""
    path = "/".join(f"w{k:02}" for k in range(30))
    known = [(f"http://a.example.net/{path}/{'win' if i % 2 else 'calm'}/{i}", "block" if i % 2 and i != 1 else "allow") for i in range(40)]
    frame = spark.createDataFrame(known, "url string, label string")
    got = {(tuple(r["tokens"]), r["label"]): (r["confidence"], r["support"]) for r in url_rules.mined(frame).collect()}
    shared = [t for t in _tokens(known[0][0]) if t not in ("path:win", "path:calm")]
    assert len(shared) > 2 * url_rules.MOST_TOKENS
    want = {((t,), "allow"): (21 / 40, 21 / 40) for t in shared}
    assert got == want | {(("path:win",), "block"): (19 / 20, 19 / 40), (("path:calm",), "allow"): (1.0, 20 / 40)}
    pages = spark.createDataFrame([(1, f"http://b.example.net/{path}/win"), (2, f"http://b.example.net/{path}")], "page_id long, url string")
    assert {r["page_id"]: r["by_tokens"] for r in url_rules.judged(pages, frame).collect()} == {1: "block", 2: "allow"}


def test_levels_give_the_rules_of_all_itemsets(spark, monkeypatch):
    rnd = random.Random(5)
    known = []
    for i in range(200):
        host, top, kind = rnd.choice(["pills", "news", "blog-a"]), rnd.choice(["net", "edu"]), rnd.choice(["safe", "win", "a"])
        bad = host == "pills" and kind != "safe" or kind == "win" and top == "net" or i % 29 == 0
        known.append((f"http://{host}.site.{top}/{kind}/{rnd.choice('xyz')}/{i}?q={i}", "block" if bad else "allow"))
    frame = spark.createDataFrame(known, "url string, label string")
    want = _mined(known, 0.01, 0.5)
    monkeypatch.setattr(url_rules, "MOST_TOKENS", 1)
    got = {(tuple(r["tokens"]), r["label"]): (r["confidence"], r["support"]) for r in url_rules.mined(frame).collect()}
    assert got == want and max(len(t) for t, _ in got) > 2
