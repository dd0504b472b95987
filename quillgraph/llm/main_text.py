"""Operator 7: main text by gradient-boosted trees over DOM nodes.

A page is parsed to a tree of elements.  Each element gets features: tag,
tokens of its class, id and role, text and link density of its subtree, depth,
and how its siblings look.  Boosted regression trees score it as content or
not; they are trained here on pages that a seeded generator writes in many
layouts, where every element's label is known.

Decoding is hierarchical.  With s the score (log odds) of an element, the best
labelling of a subtree is the better of "all of it is content, but for subtrees
that are certainly chrome" and "none of it is, but for what its children make
of themselves"; one pass up computes both and one pass down decides, so no
element contradicts the one around it.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices

# Names of elements and the rules of their nesting, as HTML has them.
#: Elements of which the content is no text, or no markup.
SKIPPED = frozenset("script style noscript template svg iframe object canvas head title select option datalist button textarea input audio video map".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a head holds; any other start tag ends an open head.
IN_HEAD = frozenset("meta link base basefont bgsound title style script noscript noframes template".split())
#: Skipped elements that hold markup and may stand in themselves, or not.
NESTED = frozenset("svg object template".split())
HOLDS = NESTED | frozenset("noscript iframe canvas select datalist button audio video map".split())
#: Elements that stand on lines of their own.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of these names, up to the boundary.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
GOOD = "article main content post entry story body text blog page hentry".split()
BAD = "nav menu header footer foot sidebar side aside widget comment reply respond ad ads advert sponsor promo banner cookie consent notice notif popup modal overlay subscribe newsletter signup login share social related recommend breadcrumb pagination pager toolbar copyright legal disclaimer form search tag meta byline author alert".split()
TAGS = "p h1 h2 h3 h4 div section article main nav header footer aside form ul ol li dl table tr td blockquote pre figure figcaption span a details address".split()
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)", re.S)  # a quote counts after = alone
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    attrs: str = ""
    children: list = field(default_factory=list)  # nodes and strings, in order
    place: int = -1


def _raw_end(html: str, tag: str, at: int) -> tuple[int, int]:
    """Where the content of a raw element ends, and its end tag."""
    end = re.compile(rf"</{re.escape(tag)}[\s/>]|$", re.I).search(html, at)
    close = html.find(">", end.start())
    return end.start(), len(html) if close < 0 else close + 1


def _closed(html: str, at: int) -> set[int]:
    """Places of the start tags in HOLDS, from ``at`` on, that have an end tag of their own."""
    out: set[int] = set()
    still: dict[str, list[int]] = {}
    while (m := _TOKEN.search(html, at)) is not None:
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1] and not m[3].rstrip().endswith("/"):
            at = _raw_end(html, tag, at)[1]
        elif tag in HOLDS:
            waiting = still.setdefault(tag, [])
            if m[1]:
                if waiting:
                    out.add(waiting.pop())
            elif not m[3].rstrip().endswith("/"):
                if tag not in NESTED:
                    waiting.clear()
                waiting.append(m.start())
    return out


def parse(html: str) -> Node:
    """The tree of a page; tags left open or out of order are mended.

    A head ends at the first text or start tag that it cannot hold, and a skipped
    element without an end tag at the next block, so that neither takes in the
    text after it.
    """
    root = Node("#root", None)
    now, at, n = root, 0, len(html)
    head: Node | None = None
    closed: set[int] | None = None
    unclosed: list[Node] = []
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if now is head and html[at:].strip():
                now = head.parent
            now.children.append(html_lib.unescape(html[at:]))
            break
        if m.start() > at:
            if now is head and html[at : m.start()].strip():
                now, head = head.parent, None
            now.children.append(html_lib.unescape(html[at : m.start()]))
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = now
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                now = up.parent
            elif tag == "p":
                now.children.append(Node("p", now))
            continue
        if unclosed and tag in BLOCKS:
            path = list(_path(now))
            for x in unclosed:  # the outermost that is still open
                if any(x is y for y in path):
                    now = x.parent
                    break
            unclosed.clear()
        if head is not None and tag not in IN_HEAD:
            up = now
            while up is not None and up is not head and (tag == "body" or up.tag not in HOLDS):
                up = up.parent
            if up is head or up is None:
                now, head = now if up is None else head.parent, None
        if tag in CLOSES_P:
            up = now
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "table", "button", "section", "article", "body"):
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in SIBLINGS:
            names, bounds = SIBLINGS[tag]
            up = now
            found = None
            while up is not root and up.tag not in bounds:
                if up.tag in names:
                    found = up
                up = up.parent
            if found is not None:
                now = found.parent
        if tag in ("html", "body") and any(x.tag == tag for x in _path(now)):
            continue
        node = Node(tag, now, m[3])
        now.children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end, after = _raw_end(html, tag, at)
            node.children.append(html[at:end])
            at = after
            continue
        if tag in HOLDS:
            closed = _closed(html, m.start()) if closed is None else closed
            if m.start() not in closed:
                unclosed.append(node)
        elif tag == "head":
            head = node
        now = node
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def elements(root: Node) -> list[Node]:
    """Elements in page order, without those that hold no text."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.place = len(out)
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and c.tag not in SKIPPED]
    return out


_INDEX = {t: i for i, t in enumerate(TAGS)}
_HINTS = re.compile(r"class|id|role|style|aria|hidden", re.I)
_NO_HINT = (0, 0, 0)


def _hints(attrs: str) -> tuple[int, int, int]:
    """Counts of tokens that speak for and against content, and whether it is hidden."""
    if not attrs or not _HINTS.search(attrs):
        return _NO_HINT
    a = attributes(attrs)
    found = _WORD.findall(" ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label")).lower())
    good = sum(any(w.startswith(g) for g in GOOD) for w in found)
    bad = sum(w in BAD or any(len(b) > 3 and w.startswith(b) for b in BAD) for w in found)
    return good, bad, int("hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""))))


def features(pages: list[list[Node]]) -> np.ndarray:
    """A row an element, of many pages at once."""
    columns: list[list] = [[] for _ in range(22)]
    for nodes in pages:
        n = len(nodes)
        own, words, ends, tags, ps, linked = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        inputs, depth, parent, tag_of, good, bad, hidden = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        up_good, up_bad, order, kids = [0] * n, [0] * n, [0] * n, [0] * n
        same: dict[tuple[int, int], int] = {}
        for i, x in enumerate(nodes):
            for c in x.children:
                if isinstance(c, str):
                    t = c.strip()
                    own[i] += len(t)
                    words[i] += t.count(" ") + (t != "")
                    ends[i] += t.count(".") + t.count("!") + t.count("?")
                elif c.tag in ("input", "select", "textarea", "button"):
                    inputs[i] += 1
            k = tag_of[i] = _INDEX.get(x.tag, len(TAGS))
            ps[i] = x.tag == "p"
            inputs[i] += x.tag == "form"
            good[i], bad[i], hidden[i] = _hints(x.attrs)
            if i:
                p = parent[i] = x.parent.place
                depth[i] = depth[p] + 1
                up_bad[i] = up_bad[p] + (bad[i] > 0 or x.tag in ("nav", "footer", "aside", "form", "header"))
                up_good[i] = up_good[p] + (good[i] > 0 or x.tag in ("article", "main"))
                order[i] = kids[p]
                kids[p] += 1
                same[p, k] = same.get((p, k), 0) + 1
        chars = own[:]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += chars[i] if nodes[i].tag == "a" else linked[i]
            words[p] += words[i]
            ends[p] += ends[i]
            tags[p] += tags[i]
            ps[p] += ps[i]
            inputs[p] += inputs[i]
        at = len(columns[0])
        alike = [same.get((parent[i], tag_of[i]), 1) for i in range(n)]
        page = (chars, own, words, ends, tags, ps, linked, inputs, depth, [p + at for p in parent], tag_of, good, bad, hidden, up_good, up_bad, order, kids, alike, [chars[0]] * n, list(range(n)), [n] * n)
        for column, more in zip(columns, page, strict=True):
            column += more
    chars, own, words, ends, tags, ps, linked, inputs, depth, parent, tag_of, good, bad, hidden, up_good, up_bad, order, kids, alike, total, place, n = (np.array(c, np.float64) for c in columns)
    parent, tag_of = parent.astype(np.int64), tag_of.astype(np.int64)
    density, siblings = linked / np.maximum(1, chars), np.maximum(1, kids[parent])
    out = [np.log1p(chars), np.log1p(own), np.log1p(words), words / tags, density, ends / np.maximum(1, words), np.log1p(tags), ps, depth, inputs, good, bad, up_good, up_bad, hidden, chars / np.maximum(1, total)]
    out += [chars / np.maximum(1, chars[parent]), density[parent], np.log1p(chars[parent]), siblings, alike, order / siblings, tag_of[parent], place / n]
    return np.concatenate((np.stack(out, axis=1), np.eye(len(TAGS) + 1)[tag_of]), axis=1)


# ------------------------------------------------------------ boosted trees


class Boosted:
    """Binary classification by second-order boosting of depth-limited trees on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        width = self.bins
        flat = codes + np.arange(d) * width
        self.base = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, inner + 1))
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, p * (1 - p) * weight
            node = np.zeros(n, np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows):
                    j, c = self._split(flat[rows], g[rows], h[rows], d, width, edges)
                    if j is not None:
                        self.feature[r, k], self.cut[r, k] = j, c
                go = x[rows, self.feature[r, k]] > self.cut[r, k] if len(rows) else np.zeros(0, bool)
                node[rows] = 2 * k + 1 + go
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.value[r] = -self.rate * gs / (hs + self.ridge)
            score += self.value[r][leaf]
        return self

    def _split(self, flat: np.ndarray, g: np.ndarray, h: np.ndarray, d: int, width: int, edges: list) -> tuple[int | None, float]:
        size = d * width
        gs = np.bincount(flat.ravel(), np.repeat(g, d), size).reshape(d, width).cumsum(axis=1)
        hs = np.bincount(flat.ravel(), np.repeat(h, d), size).reshape(d, width).cumsum(axis=1)
        ga, ha = gs[:, -1:], hs[:, -1:]
        gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
        gain[(hs < self.least) | (ha - hs < self.least)] = 0
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, b] <= 1e-6 or b >= len(edges[j]):
            return None, 0.0
        return int(j), float(edges[j][b])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        n, x = len(x), np.ascontiguousarray(x.T).ravel()
        out, rows = np.full(n, self.base), np.arange(n)
        inner = self.cut.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[f[node] * n + rows] > c[node])
            out += v[node - inner]
        return out


# -------------------------------------------------------- pages to learn from


class _Generator:
    """Pages in many layouts; content elements carry the attribute ``data-c``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        parts = "ba do ke li mo nu ra se ti vo wha ent ing ou ter por qu es ach el".split()
        out = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(w + (r.choice([",", ".", "."]) if r.random() < 0.12 else "") for w in out).capitalize()

    def sentence(self, lo: int = 6, hi: int = 30) -> str:
        return self.words(lo, hi) + self.r.choice([".", ".", "!", "?"])

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        name = r.choice([name, f"{name}-{r.choice(['wrap', 'box', 'inner', 'main', '1', 'area'])}", f"site-{name}", f"{name} clearfix"])
        return f' {r.choice(["class", "id", "class"])}="{name}"'

    def neutral(self) -> str:
        r = self.r
        return "" if r.random() < 0.5 else f' class="{r.choice(["row", "col", "wrap", "inner", "box", "x1", "c-12", "grid"])}"'

    def link(self, lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(lo, hi)}</a>'

    def links(self, n: int) -> str:
        r = self.r
        if r.random() < 0.7:
            return f"<ul{self.neutral()}>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice([" ", " | "]).join(self.link() for _ in range(n))

    def chrome(self) -> str:
        r = self.r
        k = r.randrange(13)
        if k == 0:
            return f"<{(t := r.choice(['nav', 'div']))}{self.attr('nav', 'menu', 'navbar')}>{self.links(r.randint(3, 9))}</{t}>"
        if k == 1:
            return f"<{(t := r.choice(['aside', 'div', 'section']))}{self.attr('sidebar', 'widget', 'side')}><h3>{self.words(1, 3)}</h3>{r.choice([self.links(r.randint(2, 7)), '<p>' + self.sentence() + '</p>'])}</{t}>"
        if k == 2:
            return f"<div{self.attr('ad', 'ads', 'advert', 'sponsor', 'promo', 'banner')}>{self.sentence(3, 18)}</div>"
        if k == 3:
            return f"<div{self.attr('cookie', 'notice', 'consent', 'alert', 'popup')}><p>{self.sentence(8, 25)} {self.link()}</p><button>OK</button></div>"
        if k == 4:
            return f"<form{self.attr('search', 'newsletter', 'subscribe', 'login')}><label>{self.words(1, 4)}</label><input type=text><p>{self.sentence(3, 12)}</p><button>Go</button></form>"
        if k == 5:
            n = r.randint(1, 6)
            each = r.choice(["div", "li", "article", "p"])
            body = "".join(f"<{each}{self.attr('comment', 'reply')}>{r.choice(['<b>' + self.words(1, 2) + '</b> ', ''])}<p>{self.sentence(4, 50)}</p></{each}>" if each != "p" else f"<p>{self.sentence(4, 50)}</p>" for _ in range(n))
            return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "respond", "replies", "reader-comments", "discussion comments"])}"><h3>{self.words(1, 3)}</h3>{body}</{t}>'
        if k == 6:
            return f"<div{self.attr('share', 'social')}>{self.links(r.randint(2, 5))}</div>"
        if k == 7:
            return f"<{(t := r.choice(['section', 'div', 'aside']))}{self.attr('related', 'recommend', 'more')}><h4>{self.words(1, 3)}</h4>" + "".join(f"<div>{self.link(3, 9)}</div>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if k == 8:
            return f"<div{self.attr('breadcrumb', 'pagination', 'pager')}>{self.links(r.randint(2, 5))}</div>"
        if k == 9:
            return f'<div style="display:none">{self.sentence()}</div>'
        if k == 10:
            return f"<script>var x={r.randint(1, 99)};</script>"
        if k == 11:
            return f"<aside{self.attr('aside', 'note', 'sidebar')}><p>{self.sentence(5, 30)}</p></aside>"
        return f"<!-- {self.words(1, 4)} -->"

    def block(self) -> str:
        r, c = self.r, " data-c"
        k = r.randrange(20)
        if k < 12:
            s = " ".join(self.sentence() for _ in range(r.randint(1, 5)))
            if r.random() < 0.15:
                s = self.words(1, 3) + r.choice([".", ""])
            if r.random() < 0.2:
                s += f" {self.link()} " + self.sentence()
            if r.random() < 0.2:
                s = f"<b>{self.words(1, 4)}</b> {s}"
            if r.random() < 0.1:
                s = f"<b>{s}<br>"
            return f"<p{c}>{s}" + ("</p>" if r.random() < 0.9 else "")
        if k < 14:
            return f"<h{(h := r.randint(2, 4))}{c}>{self.words(1, 8)}</h{h}>"
        if k == 14:
            t = r.choice(["ul", "ol"])
            return f"<{t}{c}>" + "".join(f"<li{c}>{r.choice([self.sentence(3, 20), self.words(1, 6)])}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if k == 15:
            return f"<blockquote{c}><p{c}>{self.sentence()}</p></blockquote>"
        if k == 16:
            return f"<table{c}>" + "".join(f"<tr{c}><td{c}>{self.words(1, 3)}</td><td{c}>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k == 17:
            return f"<figure{c}><img src=x.png><figcaption{c}>{self.sentence(3, 12)}</figcaption></figure>"
        if k == 18:
            return f"<pre{c}>{self.words(3, 20)}</pre>"
        return f"<div{c}{self.neutral()}>{self.sentence()}</div>"

    def page(self) -> str:
        r = self.r
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])
        parts = [f"<h1 data-c>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(n):
            parts.append(self.block())
            if r.random() < 0.08:
                parts.append(self.chrome())
        wrap = r.randrange(7)
        body = "".join(parts)
        if wrap == 0:
            body = f"<article data-c{self.attr('post', 'entry', 'story')}>{body}</article>"
        elif wrap == 1:
            body = f"<main data-c><article data-c>{body}</article></main>"
        elif wrap == 2:
            body = f'<div data-c class="{r.choice(["content", "post-body", "entry-content", "article-body", "story", "text"])}">{body}</div>'
        elif wrap == 3:
            body = f"<div data-c{self.neutral()}><div data-c{self.neutral()}>{body}</div></div>"
        elif wrap == 4:
            body = f"<main data-c>{body}</main>"
        elif wrap == 5:
            body = f'<article data-c><div data-c class="{r.choice(["content", "body", "inner"])}">{body}</div></article>'
        # else nothing around it
        before, after = [self.chrome() for _ in range(r.randint(0, 5))], [self.chrome() for _ in range(r.randint(0, 5))]
        if r.random() < 0.5:
            before.insert(0, f"<header{self.attr('header', 'masthead')}><div>{self.words(1, 3)}</div>{self.links(r.randint(0, 5))}</header>")
        if r.random() < 0.7:
            after.append(f"<{(t := r.choice(['footer', 'footer', 'div']))}{' class=footer' if t == 'div' else ''}>&copy; {self.words(1, 10)} {r.choice(['', self.links(3), self.sentence()])}</{t}>")
        inner = "".join(before) + body + "".join(after)
        if r.random() < 0.4:
            inner = f"<div{self.neutral()}>{inner}</div>"
        head = f"<head><meta charset=utf-8><title>{self.words(1, 8)}</title><style>p{{}}</style></head>"
        return r.choice([f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>", f"<html>{head}<body>{inner}", inner])


def trained(pages: int = 700, seed: int = 11, **options) -> Boosted:
    """The model, fitted on so many generated pages."""
    make, xs, ys, ws = _Generator(seed), [], [], []
    for _ in range(pages):
        nodes = elements(parse(make.page()))
        x = features([nodes])
        label = np.zeros(len(nodes))
        for i, node in enumerate(nodes):
            inline = node.tag not in BLOCKS and node.parent is not None
            label[i] = "data-c" in node.attrs or (inline and i > 0 and label[node.parent.place])
        keep = np.array([node.tag in BLOCKS for node in nodes])
        keep[0] = False
        xs.append(x[keep])
        ys.append(label[keep])
        ws.append(np.ones(int(keep.sum())))
    return Boosted(**options).fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


@cache
def default_model() -> Boosted:
    """The model of this process, fitted once."""
    return trained()


# ------------------------------------------------------------------ decoding


def decoded(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """Whether each element is content.

    inside[i] and outside[i] are the best sums of scores of i's subtree if i is
    content or not.  A child of content may turn to chrome and a child of chrome
    to content, at a price that keeps single doubtful elements with their
    surroundings; inline elements follow their parent.
    """
    n, price = len(nodes), 2.0
    block = [x.tag in BLOCKS for x in nodes]
    inside = np.clip(score, -8, 8).tolist()
    inside = [x if b else 0.0 for x, b in zip(inside, block, strict=True)]
    inside[0] = -1.0
    outside = [-x for x in inside]
    parent = [0] + [x.parent.place for x in nodes[1:]]
    for i in range(n - 1, 0, -1):
        p, a, b = parent[i], inside[i], outside[i]
        if block[i]:
            inside[p] += a if a >= b - price else b - price
            outside[p] += b if b >= a - price else a - price
        else:
            inside[p] += a
            outside[p] += b
    label = [inside[0] > outside[0]] + [False] * (n - 1)
    for i in range(1, n):
        up = label[parent[i]]
        if not block[i]:
            label[i] = up
        elif up:
            label[i] = inside[i] >= outside[i] - price
        else:
            label[i] = inside[i] - price > outside[i]
    return label


def blocks_of(root: Node, label: list[bool]) -> list[str]:
    """The text of content, a string a block, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is flush:
            flush()
        elif isinstance(x, tuple):
            run.append(x[0])
        elif x.tag == "br":
            run.append(" ")
        elif x.tag not in SKIPPED:
            mine = label[x.place]
            if x.tag in BLOCKS:
                flush()
                stack.append(flush)
            for c in reversed(x.children):
                if not isinstance(c, str):
                    stack.append(c)
                elif mine:
                    stack.append((c,))
    flush()
    return out


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page: blocks joined by two line feeds; empty if there is none."""
    roots = [parse(p or "") for p in pages]
    nodes = [elements(r) for r in roots]
    score, at, out = model.score(features(nodes)) if pages else None, 0, []
    for root, own in zip(roots, nodes, strict=True):
        if any(x.tag in BLOCKS for x in own):
            label = decoded(own, score[at : at + len(own)])
        else:  # text with no block around it is the article
            label = [True] * len(own)
        out.append("\n\n".join(blocks_of(root, label)))
        at += len(own)
    return out


def extracted(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    Null and empty pages give an empty text; text without any block element, such
    as plain text, is the article; pages may be of any length; repeated rows give
    equal rows; an empty table no rows; other columns are ignored.  The model
    (some hundred kB, whatever the number of pages) travels with the function.
    """
    model = model or default_model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
