"""Operator 7: main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A logistic classifier over marks of a block and of the elements around it gives
the cost of calling it content or boilerplate; these costs are the capacities to the two terminals of a graph. Smoothness edges join
blocks that follow one another and blocks that are neighbours under one parent, weaker the farther apart they are in the tree. A
maximum flow parts the graph at least cost; what stays with the source is the main text.

Blocks whose own costs outweigh all their edges are labelled first (that is exact, whatever the others get), which leaves small graphs.

A mark is what an element's name, class, id or role says it is: a menu, a footer, an advert, an article. It holds for the blocks inside
until an article or main element begins, and it holds the less the more of the page's running text lies in the element: what holds
nearly all of it is no box beside the text, whatever it is called. Names of boxes that stand anywhere (a hero, a banner, tags) give way
sooner. An element that is named as both content and box is content; a header inside an article holds its title.

The classifier is fitted on blocks of whole pages that are made by rule (:func:`made_page`) and cut up as all pages are.

Defined results: null, empty and tag-only pages give an empty text; a page cut off inside a tag, a comment or a script ends
there; unclosed and stray tags are closed or dropped; pages without any block of content give an empty text; repeated rows give equal
rows; an empty table gives an empty one; only the id, the address and the markup are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.store import in_batches

#: Elements whose content is no markup: they end at their end tag, or with the page.
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+>?.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
# Element names.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta basefont bgsound".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), ("p",))
TAG_MARK = {"svg": "hidden", "math": "hidden", "object": "hidden", "select": "form", "head": "hidden", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "main"}
MARKS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip",
    "header": "header masthead topbar logo branding",
    "footer": "footer copyright colophon legal contentinfo bottom",
    "aside": "sidebar aside widget rail related recommended recommendations newsletter subscribe trending popular complementary",
    "box": "hero banner tags promo social share sharing",
    "consent": "cookie cookies consent gdpr",
    "notice": "notice notices alert popup modal overlay paywall disclaimer warning",
    "form": "form search login signup signin register",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors doubleclick dfp",
    "comment": "comment comments disqus reply replies discussion respond reviews commentlist",
    "main": "content main post entry story maincontent",
    "article": "article articlebody",
}
WORD_MARK = {w: k for k, ws in MARKS.items() for w in ws.split()}
NAMES = ("article", "main", "menu", "header", "footer", "aside", "box", "consent", "notice", "form", "ad", "comment", "hidden", "linked", "short", "long", "sentence", "heading", "item")
FOLLOW, SIBLING = 0.6, 0.4
#: Marks that hold whatever lies in the element; the others by its share of the running text: full up to the first, none from the second.
FIRM = frozenset(("hidden", "ad", "consent"))
SHARE = {"box": (0.2, 0.5)}
USUAL = (0.8, 0.98)
CONTENT = frozenset(("article", "main"))
#: Elements that are text themselves: inside an article their classes say how they look.
TEXTUAL = frozenset("blockquote p pre figure figcaption h1 h2 h3 h4 h5 h6".split())


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    own: frozenset[str]
    last: int = -1  # number of the last block right below
    prose: int = 0  # letters of running text inside
    marks: dict[str, float] = field(default_factory=dict)  # with those of the elements around it


@dataclass
class Block:
    owner: Element
    low: int  # depth of the deepest element around this block and the one before
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _marks(name: str, attributes: str) -> set[str]:
    out = {TAG_MARK[name]} if name in TAG_MARK else set()
    if attributes and name not in ("html", "body"):
        for m in ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
            elif key in ("class", "id", "role"):
                out |= {WORD_MARK[w] for w in re.split(r"[^a-z0-9]+", value) if w in WORD_MARK}
    # Named as content as well: what else it is called is how it looks. Comments and adverts are often named after what they are on.
    return out & (CONTENT | FIRM | {"comment"}) if out & CONTENT else out


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page, in order, and its elements, each after the one around it."""
    root = Element("", None, 0, frozenset())
    here, out, block, link, low = root, [], None, 0, 0
    every = [root]

    def text(s: str) -> None:
        nonlocal block, low
        if block is None:
            if not s or s.isspace():
                return
            block, low = Block(here, min(low, here.depth)), here.depth
            out.append(block)
        block.text.append(s)
        if link:
            block.linked += len(s)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                block = None
            continue
        name = name.lower()
        if name in BLOCK:
            block = None
        if m[2]:
            e = here
            while e is not None and e.name != name:
                e = e.parent
            if e is not None:
                while here is not e:
                    link -= here.name == "a"
                    here = here.parent
                link -= here.name == "a"
                here = here.parent
                low = min(low, here.depth)
            continue
        if here.name == "head" and name not in HEAD or here.name in ("select", "optgroup", "option") and name in BLOCK and name not in ("option", "hr"):
            # A head, or a list to choose from, that was not closed.
            while here.name in ("head", "select", "optgroup", "option"):
                here = here.parent
        if name in CLOSES:
            # An open paragraph (item, cell) ends here, unless a container stands between.
            e, stop = here, CLOSES[name]
            while e is not root and e.name not in stop and (e.name not in BLOCK):
                e = e.parent
            if e.name in stop:
                while here is not e:
                    link -= here.name == "a"
                    here = here.parent
                here = here.parent
        low = min(low, here.depth)
        if name in VOID or (m[4] or "").endswith("/"):
            continue
        own = _marks(name, m[4]) - ({"header"} if name == "h1" else set())
        if name[0] == "h" and name[1:].isdigit():
            own.add("heading")
        elif name == "li":
            own.add("item")
        here = Element(name, here, here.depth + 1, frozenset(own))
        every.append(here)
        link += name == "a"
    if at < len(page):
        text(page[at:])
    return out, every


def clean(b: Block) -> str:
    return " ".join(html.unescape("".join(b.text)).split())


def running(b: Block, text: str) -> bool:
    """Whether a block is running text: long or a sentence, and not mostly links."""
    return b.linked * 2 <= sum(map(len, b.text)) and (len(text) > 120 or len(text) >= 8 and text.endswith(SENTENCE))


def weigh(found: list[Block], texts: list[str], every: list[Element]) -> None:
    """Marks of every element: its own by their share, over those around it."""
    for b, t in zip(found, texts, strict=True):
        if running(b, t):
            b.owner.prose += len(t)
    for e in reversed(every[1:]):
        e.parent.prose += e.prose
    total = max(1, every[0].prose)
    for e in every[1:]:
        inside = any(e.parent.marks.get(k) for k in CONTENT)
        if e.own & CONTENT:
            e.marks = {k: v for k, v in e.parent.marks.items() if k in CONTENT or k in FIRM or k == "comment"}
        else:
            e.marks = e.parent.marks
        gone = {"header"} if inside and e.name == "header" else set()
        if inside and e.name in TEXTUAL:
            gone = set(MARKS) - CONTENT - FIRM - {"comment"}
        own = {k: _strength(k, e.prose / total) for k in e.own - gone}
        if own:
            e.marks = e.marks | {k: max(v, e.marks.get(k, 0.0)) for k, v in own.items()}


def _strength(mark: str, share: float) -> float:
    if mark in CONTENT or mark in FIRM or mark in ("heading", "item"):
        return 1.0
    full, none = SHARE.get(mark, USUAL)
    return min(1.0, max(0.0, (none - share) / (none - full)))


SENTENCE = (".", "!", "?", "。", ":", "…")


def marks(b: Block, text: str) -> dict[str, float]:
    out = dict(b.owner.marks)
    if b.linked * 2 > sum(map(len, b.text)):
        out["linked"] = 1.0
    if len(text) < 25:
        out["short"] = 1.0
    if len(text) > 120:
        out["long"] = 1.0
    if text.endswith(SENTENCE):
        out["sentence"] = 1.0
    return out


VOCABULARY = [a + b + c for a in ("", "ta", "mo", "ri", "sen") for b in ("ka", "lo", "ne", "bu", "dri") for c in ("", "r", "sti", "en")]


def made_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """(markup, is content of each block): a page made by rule, its article in one of many kinds of elements among boxes of all kinds."""
    pick = lambda *of: of[int(r.integers(len(of)))]
    words = lambda low, high: " ".join(VOCABULARY[k] for k in r.integers(0, len(VOCABULARY), int(r.integers(low, high))))
    label: list[bool] = []

    def block(text: str, content: bool, tag: str = "p") -> str:
        label.append(content)
        return f"<{tag}>{text}</{tag}>"

    def prose(n: int, content: bool) -> str:
        bare = 0.25 if content else 0.0  # verses, tables and lists of an article end as they like
        return "".join(block(words(*pick((4, 12), (12, 60), (40, 120))) + ("" if r.random() < bare else pick(".", ".", "!", "?")), content) for _ in range(n))

    def links(n: int) -> str:
        return "<ul>" + "".join(block(f"<a href=x>{words(1, 4)}</a>", False, "li") for _ in range(n)) + "</ul>"

    def box() -> str:
        kind = pick(*(k for k in MARKS if k not in CONTENT))
        name = pick(*MARKS[kind].split())
        opened = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        start, end = (f"<{opened[kind]}>", f"</{opened[kind]}>") if kind in opened and r.random() < 0.4 else (f'<div class="{pick("", "x ", "site-")}{name}">', "</div>")
        inside = pick("links", "line", "prose") if kind in ("menu", "header", "footer", "box", "form") else pick("line", "prose", "prose", "links")
        if r.random() < 0.1:
            start = f"<div {pick('hidden', 'style=display:none', 'aria-hidden=true')}>"
            end = "</div>"
        head = block(words(1, 4), False, pick("h1", "h2", "h3")) if r.random() < 0.4 else ""
        body = links(int(r.integers(2, 9))) if inside == "links" else block(words(2, 9), False) if inside == "line" else prose(int(r.integers(1, 6 if kind == "comment" else 3)), False)
        return start + head + body + end

    def boxes(low: int, high: int) -> str:
        return "".join(box() for _ in range(int(r.integers(low, high))))

    def article() -> str:
        head = block(words(3, 10), True, "h1")
        out = f"<header>{head}</header>" if r.random() < 0.2 else head
        for _ in range(int(r.integers(1, 6))):
            out += prose(int(r.integers(1, 4)), True)
            what = r.random()
            if what < 0.15:
                out += block(words(2, 6), True, "h2")
            elif what < 0.3:
                out += "<ul>" + "".join(block(words(2, 12), True, "li") for _ in range(int(r.integers(2, 5)))) + "</ul>"
            elif what < 0.4:
                out += f'<blockquote class="{pick("quote", "social", "share")}">{words(8, 20)}.</blockquote>'
                label.append(True)
            elif what < 0.6:
                out += box()
        return out

    page = boxes(1, 4)
    start, end = pick(
        ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ('<section class="hero">', "</section>"),
        ('<div class="banner-post content">', "</div>"), ('<article><div class="tags story">', "</div></article>"), ('<main><section class="hero">', "</section></main>"), ("<div>", "</div>"), ("<form>", "</form>"), ("", ""),
    )
    page += start + article() + end + boxes(1, 4)
    return f"<html><head><title>t</title></head><body>{page}</body></html>", label


def labelled_table(pages: int = 300, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(marks, is content) of the blocks of made pages."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page, label = made_page(r)
        found, texts, _ = seen(page)
        for b, t in zip(found, texts, strict=True):
            m = marks(b, t)
            x.append([m.get(n, 0.0) for n in NAMES])
        y += label
    return np.array(x), np.array(y, dtype=float)


@lru_cache
def fitted(steps: int = 600, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights of NAMES and the bias."""
    x, y = labelled_table()
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) / len(y) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness: neighbours in the page, and neighbours under one parent or one of its parents."""
    out: dict[tuple[int, int], float] = {}
    for i in range(1, len(found)):
        out[i - 1, i] = FOLLOW / (1 + found[i - 1].owner.depth + found[i].owner.depth - 2 * found[i].low)  # steps in the tree
    for b in found:
        e = b.owner.parent
        for _ in range(2):
            if e is not None:
                e.last, e = -1, e.parent
    for i, b in enumerate(found):
        up, e = 0, b.owner.parent
        while e is not None and up < 2:
            if e.last >= 0:
                out[e.last, i] = out.get((e.last, i), 0.0) + SIBLING / (1 + up)
            e.last = i
            e, up = e.parent, up + 1
    return out


def minimum_cut(gain: list[float], between: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: ``gain[i]`` is what node i loses if it isn't content (if negative, if it is); an edge costs its weight if its ends differ."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in between.items():
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    gain, label = list(gain), [None] * n
    open_ = deque(range(n))
    while open_:
        i = open_.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    open_.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, gain, near)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a least cut; shortest augmenting paths."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if gain[i] > 0:
            left[source][i] = gain[i]
            left[i][source] = 0.0
        elif gain[i] < 0:
            left[i][sink] = -gain[i]
            left[sink][i] = 0.0
    while True:
        came, todo = {source: source}, deque([source])
        while todo and sink not in came:
            i = todo.popleft()
            for j, c in left[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    todo.append(j)
        if sink not in came:
            return set(came) - {source}
        path, j, least = [], sink, math.inf
        while j != source:
            i = came[j]
            path.append((i, j))
            least = min(least, left[i][j])
            j = i
        for i, j in path:
            left[i][j] -= least
            left[j][i] = left[j].get(i, 0.0) + least


def seen(page: str) -> tuple[list[Block], list[str], list[Element]]:
    """(blocks with a text, their texts, elements), with marks weighed."""
    blocks_of, elements = blocks(page)
    found, texts, low = [], [], math.inf
    for b in blocks_of:
        low = min(low, b.low)
        if t := clean(b):
            b.low = low
            found.append(b)
            texts.append(t)
            low = math.inf
    weigh(found, texts, elements)
    return found, texts, elements


def main_text(page: str | None, weights: np.ndarray) -> str:
    if not page:
        return ""
    index = {n: float(w) for n, w in zip(NAMES, weights, strict=False)}
    bias = float(weights[-1])
    found, texts, _ = seen(page)
    gain = [max(-12.0, min(12.0, bias + sum(index[m] * v for m, v in marks(b, t).items()))) for b, t in zip(found, texts, strict=True)]
    return " ".join(t for t, k in zip(texts, minimum_cut(gain, edges(found)), strict=True) if k)


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    weights = fitted() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), weights) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_batches(pages).select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
