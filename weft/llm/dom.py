"""Operator 9, HTML extraction: gradient-boosted trees over the nodes of the DOM.

A page is parsed into a tree of elements, tolerant of missing end tags. Every element is described by
its tag, depth, the density of text and of links in its subtree, tokens of its class, id and role, and
its siblings; boosted trees give the probability that it belongs to the main text. Decoding is
hierarchical: an element is kept whole, dropped whole or mixed, and the labelling of highest total score
in which the parts of a kept (dropped) element are kept (dropped) is found from the leaves up.

The trees are trained here, on pages that a seeded generator writes with known roles.

Scale: a map over pages; the model is some thousand numbers, sent to every task.

Defined cases: a null or empty page, and one without main text, give an empty text; ties keep; repeated
rows repeat; tags that are cut off at the end of the page are dropped, as is what follows a script, style,
textarea or title that nothing ends; a quote in a tag that nothing ends is an ordinary sign; an svg that
ends itself, and a noscript, template, iframe or svg without an end tag, hide nothing; pages may nest as
deep and be as long as they like, in time linear in their length; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES, DEPTH, RATE = 60, 3, 0.3
TRAINING_PAGES = 600
STEP = 1 << 20  # bytes of pages that are scored together
_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_NAMES = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEXT = frozenset("script style textarea title".split())  # without an end they take the rest of the page
_HOLDERS = ("p", "div", "td", "li", "article", "section", "body")
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var br img wbr input del ins".split())
#: What a start tag ends, if it is open: paragraphs, items and cells need no end tag.
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div section article aside nav header footer main form table pre blockquote figure address fieldset hr".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
KINDS = "html head body nav header footer aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th form button select figure figcaption blockquote pre script style title".split()
WORDS = {
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted banner",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside widget related recommended trending popular",
    "foot": "footer foot copyright legal colophon",
    "head": "header masthead topbar logo branding",
    "note": "cookie cookies consent notice notification alert popup modal overlay gdpr newsletter subscribe signup banner",
    "talk": "comment comments reply replies disqus discussion respond",
    "form": "form login search input share social",
    "text": "content article post entry story body main text page blog",
}
_GROUP = {w: k for k, names in enumerate(WORDS.values()) for w in names.split()}


class Node:
    __slots__ = ("attrs", "blocks", "children", "depth", "links", "parent", "size", "tag", "tags")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str]] = []  # own text, with its place on the page
        self.size = self.links = self.tags = 0


class _Tags:
    """Tags of a page from a place on; each look goes forward, so a page takes time in proportion to its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.without: set[str] = set()  # elements without an end tag from here on

    def find(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it ends an element, attributes) of the next tag; the name is empty for comments and the like."""
        page, n = self.page, len(self.page)
        m = _OPEN.search(page, pos)
        if not m:
            return None
        start, at = m.span()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, n if end < 0 else end + 3, "", False, ""
        if page[start + 1] in "!?":
            end = page.find(">", at)
            return start, n if end < 0 else end + 1, "", False, ""
        closing = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        at = name.end()
        if self.last[">"] < at:
            return start, n, "", False, ""  # cut off at the end of the page
        while True:
            stop = _STOP.search(page, at)
            if not stop:
                return start, n, "", False, ""
            c, at = stop.group(), stop.end()
            if c == ">":
                break
            if self.last[c] >= at:
                at = page.index(c, at) + 1
            else:  # a quote that nothing ends is an ordinary sign
                if self.last[">"] < at:
                    return start, n, "", False, ""
        return start, at, name.group().lower(), closing, page[name.end() : at - 1]

    def after(self, name: str, pos: int) -> int | None:
        """The place after the element's end tag."""
        if name in self.without:
            return None
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, pos)
        if not end:
            self.without.add(name)
            return None
        return end.end()


def parse(page: str) -> Node:
    root = Node("html", "", None)
    at, inline, order = root, [], 0
    pos, link = 0, 0
    stack, opened = [root], {}  # open elements, and their places by tag

    def flush():
        nonlocal inline, order
        if inline:
            text = " ".join(html.unescape("".join(inline)).split())
            if text:
                at.blocks.append((order, text))
                order += 1
            inline = []

    def latest(names) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def close(depth: int) -> None:
        """End the open elements from this place on."""
        nonlocal at
        while len(stack) > depth:
            opened[stack.pop().tag].pop()
        at = stack[-1]

    n, tags = len(page), _Tags(page)
    while pos < n:
        tag = tags.find(pos)
        stop = tag[0] if tag else n
        if stop > pos:
            inline.append(page[pos:stop])
            if link:
                at.links += stop - pos
        if not tag:
            break
        _, pos, name, closing, attrs = tag
        if not name:
            continue
        if closing:
            if name == "a":
                link = max(0, link - 1)
            if name not in INLINE and opened.get(name):
                flush()
                close(opened[name][-1])
            continue
        if name == "br":
            inline.append(" ")
            continue
        if name in INLINE:
            at.tags += 1
            link += name == "a"
            continue
        flush()
        link = 0
        if name == "html":
            continue
        if name in _PARAGRAPH:
            k = latest(_HOLDERS)
            if k and stack[k].tag == "p":
                close(k)
        elif name in _ENDS:
            k = latest((*_ENDS[name], *_SCOPES[name]))
            if k and stack[k].tag in _ENDS[name]:
                close(k)
                if name == "tr" and at.tag == "tr":
                    close(len(stack) - 1)
        node = Node(name, attrs, at)
        at.children.append(node)
        alone = name in VOID or attrs.endswith("/")
        if name in RAW and not (alone and name == "svg"):
            end = tags.after(name, pos)
            if end is not None or name in _TEXT:
                pos = n if end is None else end
                continue
        if not alone:
            opened.setdefault(name, []).append(len(stack))
            stack.append(node)
            at = node
    flush()
    return root


def describe(root: Node) -> tuple[list[Node], list[list[float]]]:
    """Nodes in page order (parents first) and their features."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):  # sums over subtrees
        node.size += sum(len(t) for _, t in node.blocks)
        node.tags += 1
        if node.parent:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.tags += node.tags
    total = max(1, root.size)
    rows, inherited, alike = [], {}, {}
    for node in nodes:
        groups = [0.0] * len(WORDS)
        if node.attrs:
            for m in _NAMES.finditer(node.attrs):
                for w in _TOKEN.findall((m.group(2) or m.group(3) or m.group(4) or "").lower()):
                    if w in _GROUP:
                        groups[_GROUP[w]] = 1.0
        above = inherited[id(node.parent)] if node.parent else ([0.0] * len(WORDS), (0.0,) * 7)
        tags = above[1]
        own = tuple(float(node.tag == t) for t in ("nav", "header", "footer", "aside", "article", "main", "form"))
        groups_above = above[0]
        inherited[id(node)] = ([max(a, b) for a, b in zip(groups, groups_above)], tuple(max(a, b) for a, b in zip(own, tags)))
        family = node.parent.children if node.parent else [node]
        if node.parent and id(node.parent) not in alike:
            alike[id(node.parent)] = Counter(x.tag for x in family)
        rows.append(
            [KINDS.index(node.tag) if node.tag in KINDS else len(KINDS), node.depth, np.log1p(node.size), node.size / node.tags, node.links / max(1, node.size), node.size / total, len(family), node.size / max(1, node.parent.size if node.parent else total), alike[id(node.parent)][node.tag] if node.parent else 1, len(node.children), *own, *tags, *groups, *groups_above]
        )
    return nodes, rows


class Boosted:
    """Logistic gradient boosting of small trees, all of one depth, on thresholds at quantiles."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1])) for k in range(x.shape[1])]
        tests = [(k, c) for k, own in enumerate(cuts) for c in own]
        above = np.stack([x[:, k] > c for k, c in tests], axis=1)
        score = np.full(len(y), self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(at == node)
                    if len(own) < 8:
                        continue
                    up = above[own]
                    gr, hr = g[own] @ up, h[own] @ up
                    gt, ht = g[own].sum(), h[own].sum()
                    gain = gr**2 / (hr + 1) + (gt - gr) ** 2 / (ht - hr + 1) - gt**2 / (ht + 1)
                    best = int(np.argmax(gain))
                    if gain[best] > 1e-3:
                        feature[node], cut[node] = tests[best]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            own = at - (2**DEPTH - 1)
            leaf = np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + 1) * RATE
            score += leaf[own]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def write_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    word = lambda: "".join(rng.choice(["an", "the", "er", "st", "ion", "ou", "ch", "le", "qu", "ro"]) for _ in range(rng.randint(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    some = lambda *x: rng.choice(x)

    def boiler(kind: str) -> str:
        items = lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
        return {
            "nav": lambda: some(f"<nav><ul>{items()}</ul></nav>", f'<div class="{some("menu", "navbar", "breadcrumbs")}"><ul>{items()}</ul></div>', f'<ul id="navigation">{items()}</ul>'),
            "ad": lambda: some(f'<div class="{some("ad", "ads", "advert", "sponsored", "promo")}">{text(3, 20)}</div>', f'<aside class="advertisement"><p>{text(3, 30)}</p></aside>'),
            "header": lambda: some(f"<header><div>{word()}</div>{link()}</header>", f'<div id="header"><p>{text(2, 6)}</p></div>'),
            "footer": lambda: some(f"<footer>&copy; {word()} &middot; {text(3, 12)}</footer>", f'<div class="footer"><p>{text(4, 20)}</p></div>', f"<footer><p>{text(3, 12)}</p><ul>{items()}</ul></footer>"),
            "side": lambda: some(f"<aside><h3>{text(1, 3)}</h3><ul>{items()}</ul></aside>", f'<div class="{some("sidebar", "related", "widget")}"><h3>{text(1, 3)}</h3><p>{text(4, 40)}</p></div>'),
            "note": lambda: f'<div class="{some("cookie-notice", "notice", "consent", "newsletter", "popup")}"><p>{text(5, 30)}</p><button>{word()}</button></div>',
            "form": lambda: f'<form action="/s"><p>{text(2, 8)}</p><label>{word()}</label><input name="q"><button>{word()}</button></form>',
            "talk": lambda: f'<{(t := some("section", "div"))} {some("id", "class")}="{some("comments", "comment-list", "discussion")}"><h3>{text(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{text(4, 40)}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
        }[kind]()

    kinds = ["nav", "ad", "header", "footer", "side", "note", "form", "talk"]
    body, kept = [], []
    heading = text(3, 9)
    body.append(f"<h1>{heading}</h1>")
    kept.append(heading)
    for _ in range(rng.randint(1, 12)):
        block = text(1, some(3, 12, 60, 120))
        kind = rng.random()
        if kind < 0.7:
            body.append(f"<p>{some('', '<b>')}{block}{some('</p>', '</p>', '<br>')}")
        elif kind < 0.8:
            body.append(f"<h2>{block}</h2>")
        elif kind < 0.9:
            body.append(f"<ul><li>{block}</li></ul>")
        else:
            body.append(f"<blockquote>{block}</blockquote>")
        kept.append(block)
        if rng.random() < 0.12:
            body.append(boiler(some("ad", "note", "form", "side")))
    open_, close = some(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ('<section class="article-body">', "</section>"))
    before = "".join(boiler(k) for k in rng.sample(kinds[:3] + ["note", "form"], rng.randint(0, 4)))
    after = "".join(boiler(k) for k in rng.sample(["side", "talk", "ad", "form", "nav", "note"], rng.randint(0, 4))) + (boiler("footer") if rng.random() < 0.9 else "")
    page = f"<!DOCTYPE html><html><head><title>{heading}</title><style>p{{margin:0}}</style><script>x('</p>');</script></head><body>{before}{open_}{''.join(body)}{close}{after}" + some("</body></html>", "")
    return page, kept


@lru_cache(maxsize=1)
def train(pages: int = TRAINING_PAGES, seed: int = 9) -> Boosted:
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        page, kept = write_page(rng)
        nodes, rows = describe(parse(page))
        left = list(kept)
        own, all_ = {}, {}
        for node in nodes:
            mine = 0
            for _, t in node.blocks:
                if left and t == left[0]:
                    left.pop(0)
                    mine += len(t)
            own[id(node)], all_[id(node)] = mine, mine
        for node in reversed(nodes):
            if node.parent:
                all_[id(node.parent)] += all_[id(node)]
        for node, row in zip(nodes, rows):
            if node.size:
                x.append(row)
                y.append(all_[id(node)] > 0.5 * node.size)
    return Boosted().fit(np.array(x, float), np.array(y, float))


def decode(nodes: list[Node], score: np.ndarray) -> str:
    """Text of the best labelling; score: log odds of each node."""
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    place = {id(node): k for k, node in enumerate(nodes)}
    up, down, best = keep.copy(), drop.copy(), np.zeros(len(nodes))
    free = np.zeros(len(nodes))
    mixed = np.zeros(len(nodes), bool)
    for k in range(len(nodes) - 1, -1, -1):
        # mixed: own text goes by its own score, which may stand against its parts'
        own = max(keep[k], drop[k]) if nodes[k].blocks else 0.0
        mixed[k] = bool(nodes[k].children) and own + free[k] > max(up[k], down[k])
        best[k] = max(up[k], down[k], own + free[k] if nodes[k].children else -np.inf)
        if nodes[k].parent is not None:
            p = place[id(nodes[k].parent)]
            up[p] += up[k]
            down[p] += down[k]
            free[p] += best[k]
    state = np.zeros(len(nodes), np.int8)  # 1 kept, -1 dropped, 0 mixed
    found: list[tuple[int, str]] = []
    for k, node in enumerate(nodes):
        above = state[place[id(node.parent)]] if node.parent is not None else 0
        state[k] = above or (0 if mixed[k] else 1 if up[k] >= down[k] else -1)
        if node.blocks and (state[k] == 1 or (state[k] == 0 and keep[k] >= drop[k])):
            found += node.blocks
    return "\n".join(t for _, t in sorted(found))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        model = shared.value
        for batch in batches:
            _, offsets = common.utf8(batch.column("html"))
            for first, end in common.spans(offsets, STEP):
                part = batch.slice(first, end - first)
                described = [describe(parse(x or "")) for x in part.column("html").to_pylist()]
                score = model.score(np.array([row for _, rows in described for row in rows], float))
                ends = np.append(0, np.cumsum([len(rows) for _, rows in described]))
                texts = [decode(nodes, score[a:b]) for (nodes, _), a, b in zip(described, ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
