import itertools

import numpy as np
import pytest

from sparklode.llm import mainhtml, neighbours, pieces, store

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<main><article><h1>Title</h1><p>First para is <b>bold</b> and&nbsp;long enough to be read&mdash;by anyone.</p><p>Ok.</p><aside>see also</aside><form><p>mail</p><input></form>
<ul><li>One item</li><li>Two</li></ul><div class="ad">Buy now.</div></article><section id="comments"><h2>Comments</h2><p>Great article, I liked it very much indeed, thanks a lot.</p></section></main>
<div id=sidebar><p>Long sidebar text that goes on and on. Really it does.</p></div><script>var a="<p>x</p>"</script><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    pages = [PAGE, None, "", "<div>", "<article><p>Cut off in a <a href=", "<article><p>a  b\n c<p>d<script>x", "<ul><li><a href=1>x</a></li></ul>", "<article>1 &lt; 2 &amp;amp; 3.</article>", "<article><p>" + "long text. " * 20_000 + "</article>"]
    t = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in mainhtml.extracted(t).collect()}
    assert got[0]["text"] == "Title First para is bold and long enough to be read—by anyone. Ok. One item Two"
    assert [got[i]["text"] for i in (1, 2, 3, 6)] == [""] * 4
    assert got[4]["text"] == "Cut off in a" and got[5]["text"] == "a b c d" and got[7]["text"] == "1 < 2 &amp; 3."
    assert got[8]["n_chars"] == len("long text. " * 20_000) - 1 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert mainhtml.extracted(t.filter("page_id < 0")).count() == 0


def test_main_text_of_all_pages(spark):
    """The article element is the main text of the driver's pages."""
    import html
    import re

    w = mainhtml.fitted()
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        a = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        a = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", a))
        assert mainhtml.main_text(r["html"], w) == " ".join(html.unescape(a).split())


ARTICLE = "<p>The river rose by two metres during the night, and the old bridge was closed.</p><p>Nobody was hurt, as the town had been warned in good time.</p>"
TEXT = "The river rose by two metres during the night, and the old bridge was closed. Nobody was hurt, as the town had been warned in good time."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body>{}</body></html>",
        "<html><head><title>T</title></head><body><svg/>{}</body></html>",
        "<html><body><select name=x><option>One<option>Two{}</body></html>",
        "<html><body><head-bar></head-bar>{}</body></html>",
        '<html><body><form action="/page.aspx">{}</form></body></html>',
        '<html><body><nav><a href=1>Home</a></nav><section class="hero">{}</section></body></html>',
        '<html><body><div class="product reviews">{}</div><footer>© 2024 Example</footer></body></html>',
        '<html><body><div class="post tags">{}</div></body></html>',
    ],
)
def test_main_text_of_odd_pages(page):
    w = mainhtml.fitted()
    assert mainhtml.main_text(page.format(ARTICLE), w).removeprefix("One ").removeprefix("Two ") == TEXT


TITLE, BEFORE, THANKS = "A flood in the town", "One more thing was said before all of that.", "<p>Great article, I liked it very much indeed, thanks to you all for it.</p>" * 5


@pytest.mark.parametrize(
    "page,want",
    [
        ('<h1>A flood in the town</h1><section class="hero">{}</section>', f"{TITLE} {TEXT}"),
        ('<div class="banner-post content">{}</div><p>Ok then.</p>', f"{TEXT} Ok then."),
        ('<article><div class="tags story">{}</div></article>', TEXT),
        ('<main><section class="hero">{}</section></main>', TEXT),
        ('<div id="content"><blockquote class="social">{}</blockquote></div>', TEXT),
        ("<article><header><h1>A flood in the town</h1></header>{}</article>", f"{TITLE} {TEXT}"),
        (f'<article><p>{BEFORE}</p><div class="tags story">{{}}</div></article>', f"{BEFORE} {TEXT}"),
        (f'<article><p>{BEFORE}</p><section class="hero">{{}}</section></article>', f"{BEFORE} {TEXT}"),
        (f'<article><p>{BEFORE}</p><blockquote class="social">{{}}</blockquote></article>', f"{BEFORE} {TEXT}"),
        (f'<article>{{}}<section id="comments"><h2>Comments</h2>{THANKS}</section></article>', TEXT),
        (f'<div>{{}}</div><div class="comments">{THANKS}</div>', TEXT),
        (f'<div>{{}}</div><div style="display: none">{THANKS}</div><div class="related"><h3>More</h3><ul><li><a href=1>One</a></li></ul></div>', TEXT),
    ],
)
def test_main_text_by_nearest_marks_and_share(page, want):
    assert mainhtml.main_text(page.format(ARTICLE), mainhtml.fitted()) == want


def test_main_text_of_held_out_pages():
    """Blocks of pages that weren't made for the fit; and without the cut some of them get another label."""
    r, w = np.random.default_rng(99), mainhtml.fitted()
    right = wrong = missed = changed = 0
    for _ in range(150):
        page, label = mainhtml.made_page(r)
        found, texts, _ = mainhtml.seen(page)
        assert len(found) == len(label)
        weight = dict(zip(mainhtml.NAMES, w, strict=False))
        gain = [float(w[-1]) + sum(weight[k] * v for k, v in mainhtml.marks(b, t).items()) for b, t in zip(found, texts, strict=True)]
        kept = mainhtml.minimum_cut(gain, mainhtml.edges(found))
        right += sum(k and x for k, x in zip(kept, label, strict=True))
        wrong += sum(k and not x for k, x in zip(kept, label, strict=True))
        missed += sum(x and not k for k, x in zip(kept, label, strict=True))
        changed += sum(k != (g > 0) for k, g in zip(kept, gain, strict=True))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95 and changed > 0


def test_main_text_keeps_out_what_stands_alone():
    w = mainhtml.fitted()
    assert mainhtml.main_text('<div class="cookie-notice">We use cookies to make this page better for you.</div>', w) == ""
    assert mainhtml.main_text(PAGE.replace("First para", "X"), w).startswith("Title X")
    deep = "<div>" * 20_000 + ARTICLE + "".join(f"<p>Sentence number {i} of the long and deep page.</p></div>" for i in range(3000))
    assert mainhtml.main_text(deep, w).startswith(TEXT)


def test_main_text_repeated_rows_and_clashing_columns(spark):
    t = spark.createDataFrame([(1, "u", ARTICLE, 5)] * 3 + [(None, None, ARTICLE, 5)], "page_id long, url string, html string, n_chars int")
    got = mainhtml.extracted(t).collect()
    assert len(got) == 4 and {r["text"] for r in got} == {TEXT} and {r["n_chars"] for r in got} == {len(TEXT)}


@pytest.mark.parametrize("seed", range(12))
def test_minimum_cut_is_least(seed):
    r = np.random.default_rng(seed)
    n = 9
    gain = list(r.normal(0, 1, n))
    edge = {(i, j): float(r.random()) for i in range(n) for j in range(i + 1, n) if r.random() < 0.35}

    def cost(label):
        return sum(abs(g) for g, x in zip(gain, label, strict=True) if (g > 0) != x) + sum(w for (i, j), w in edge.items() if label[i] != label[j])

    least = min(cost(x) for x in itertools.product((False, True), repeat=n))
    assert cost(mainhtml.minimum_cut(gain, edge)) == pytest.approx(least)


def test_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0] * 15 + [None], 0), (2004, [float("inf")] * 16, 0), (2020, [1.0] * 3, 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    found = neighbours.searched(t).toPandas()
    v = x.astype(np.float32).astype(np.float64)
    hits = total = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        score = v @ v[q]
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id) and g.vec_id.is_unique
        assert np.allclose(g.score, score[g.vec_id], atol=0, rtol=1e-14) and list(g.vec_id) == [i for _, i in sorted(zip(-g.score, g.vec_id, strict=True))]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -score))[:20]) & set(g.vec_id))
        total += 20
    assert found.query_id.nunique() == 75 and hits / total >= 0.9
    few = neighbours.searched(t.filter("vec_id < 5")).toPandas()
    assert len(few) == 4 and set(few.query_id) == {0}
    assert neighbours.searched(t.filter("vec_id < 0")).count() == 0


def test_neighbours_repeated_ids(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(7, [float(v) for v in x[7]])] * 40 + [(9, [float(v) for v in 3 * x[9]]), (20, [float(v) for v in x[20]])]
    found = neighbours.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    for q, g in found.groupby("query_id"):
        score = x @ x[q]
        score[9] = max(score[9], 3 * score[9])
        score[q] = -np.inf
        g = g.sort_values("rank")
        assert len(g) == 20 and g.vec_id.is_unique and list(g.vec_id) == list(np.lexsort((np.arange(300), -score))[:20]), q


def test_pipeline_stages(spark, data):
    import corpus_pipeline as c

    names = [n for n, _ in c.STAGES]
    assert names == ["quality", "near_copies", "secrets", "mix", "pieces"]
    rows = spark.read.parquet(f"{data}/documents.parquet")
    columns, tables = rows.columns, [rows]
    for _, f in c.STAGES:
        tables.append(store.materialize(f(spark, tables[-1], data), "t"))
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and all(t.columns == columns for t in tables[:-1])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 0").collect()}
    assert len(bad & ids[1]) <= 0.1 * len(bad)
    from tests.llm.test_documents import brute_groups

    kept = [(r["doc_id"], r["text"]) for r in tables[1].orderBy("doc_id").collect()]
    groups = brute_groups([t for _, t in kept], c.SHINGLE, c.SIMILARITY)
    assert ids[2] == {d for k, (d, _) in enumerate(kept) if groups[k][1] == k}
    assert tables[3].count() == len(ids[3]) == len(ids[2])
    v = pieces.read()
    texts = {r["doc_id"]: r["text"] for r in tables[4].collect()}
    assert tables[5].count() == tables[4].count() and all(pieces.decoded(r["ids"], v) == texts[r["doc_id"]] for r in tables[5].collect())
    assert {r["doc_id"] for r in c.run(spark, data).collect()} == ids[5]
