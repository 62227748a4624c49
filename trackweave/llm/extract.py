"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text with the path of open elements. A classifier gives each block a
cost for either label - the capacities to the terminals - and blocks that follow each other, or
share near ancestors, are tied by smoothness edges. The minimum cut is the cheapest labelling.

The classifier is a logistic model trained on the corpus: blocks below elements that name their role
(article, nav, footer and so on) are labelled examples, for the features that do not name it.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: Pages whose blocks the classifier is fitted to: those first by a hash of their id.
TRAIN_PAGES = 400
#: An edge weighs so much divided by the steps between two blocks in the tree: one to the block before, and
#: one to the block before below the same element.
NEAR, SAME_PARENT = 3.6, 1.2
#: Cost of keeping a block below a class or id that names another role; log odds go to 4, so that they can outweigh it.
NAMED = 3.0

# Element and class names with a role (fixed values).
_RAW = frozenset(("script", "style", "textarea", "title"))
_EMBED = frozenset(("noscript", "template", "svg", "iframe", "select", "option", "button", "canvas", "object"))
_DROP = frozenset(("form", "head")) | _EMBED
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "math", "mi", "mn", "mo", "mrow", "mtext", "msub", "msup", "msubsup", "mfrac", "msqrt", "mover", "munder", "semantics"))
_IN_HEAD = frozenset(("head", "meta", "link", "base", "title", "style", "script", "noscript", "template"))
_BAD_TAG = frozenset(("nav", "header", "footer", "aside", "menu", "dialog"))
_GOOD_TAG = frozenset(("article", "main"))
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|menu|header|footer|sidebar|side|ad|ads|advert\w*|banner|promo|sponsor\w*|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comment|comments|disqus|reply|replies|breadcrumb\w*|pagination|pager|login|search|toolbar|widget|copyright|legal|disclaimer)(?=$|[\s_-])", re.I)
_MODIFIER = re.compile(r"(?:has|with|without|no|show|hide)[_-]|.*[_-](?:open|closed|enabled|disabled)$", re.I)  # says what else a page has
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?=$|[\s_-])", re.I)
_ROLE = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_P_CLOSERS = frozenset("p div ul ol dl table article section main aside nav header footer form blockquote pre h1 h2 h3 h4 h5 h6 hr address figure".split())


@dataclass(slots=True)
class Block:
    text: str
    tag: str  # the element that holds it
    parent: int  # number of that element's parent
    hint: int  # of the ancestors that name a role: 1 main text, -1 another role by class or id, -2 by element, role or hidden
    links: int  # characters within links
    steps: int  # in the tree, to the block before
    place: float = 0.0


def _hint(tag: str, attrs: str) -> int:
    if tag in _BAD_TAG:
        return -2
    good, bad = tag in _GOOD_TAG, False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return -2
            if name == "role" and value.lower() in _ROLE:
                return 1 if _ROLE[value.lower()] > 0 else -2
            if name in ("class", "id"):
                for word in value.split():
                    if _BAD_NAME.search(word):
                        bad |= not _MODIFIER.match(word)
                    elif _GOOD_NAME.search(word):
                        good = True
    if tag in _GOOD_TAG:
        return 1
    if tag in ("html", "body"):
        return 0  # their classes tell what the page has, not what it is
    return 0 if good == bad else 1 if good else -1


def _inherited(tag: str, own: int, up: int) -> int:
    if own == -2 or up == -2:
        return -2
    if up == -1 and tag not in _GOOD_TAG:
        return -1
    return own or up


class _Open:
    """The open elements of a page, each with its number, hint, nearest block element and count of block elements.

    Where an element of a name is open is kept by name, so that no step looks through the whole of a deep page.
    """

    def __init__(self):
        self.stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]  # name, number, hint, place of the nearest block, blocks so far
        self.at: dict[str, list[int]] = {}
        self.up, self.depth = [0], [0]  # by number
        self.links = self.dropped = self.foreign = 0

    def push(self, tag: str, own: int) -> None:
        k, top = len(self.stack), self.stack[-1]
        inline = tag in _INLINE
        self.up.append(top[1])
        self.depth.append(k)
        hint = top[2] if own == 0 or (tag == "header" and self.good()) else _inherited(tag, own, top[2])
        self.stack.append((tag, len(self.up) - 1, hint, top[3] if inline else k, top[4] + (not inline)))
        self.at.setdefault(tag, []).append(k)
        self._count(tag, 1)

    def good(self) -> bool:
        return any(self.at.get(tag) for tag in _GOOD_TAG)

    def find(self, tag: str) -> int:
        own = self.at.get(tag)
        return own[-1] if own else 0

    def cut(self, k: int) -> None:
        """Close the element at ``k`` and all within it."""
        for gone in self.stack[k:]:
            self.at[gone[0]].pop()
            self._count(gone[0], -1)
        del self.stack[k:]

    def _count(self, tag: str, n: int) -> None:
        self.links += n * (tag == "a")
        self.dropped += n * (tag in _DROP)
        self.foreign += n * (tag in ("svg", "math"))

    def steps(self, a: int, b: int) -> int:
        """In the tree between what two elements hold."""
        n = 2
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, n = self.up[a], n + 1
        return n


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; scripts, styles, forms, comments and the head are left out."""
    out: list[Block] = []
    tree = _Open()
    stack = tree.stack
    parts: list[str] = []
    ended: dict[str, int] = {}  # the last end of an element in the page
    links = at = before = 0

    def close():
        nonlocal links, before
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                k = stack[-1][3]
                above = stack[max(0, k - 1)][1]
                out.append(Block(text, stack[k][0], above, stack[k][2], min(links, len(text)), tree.steps(before, above)))
                before = above
            parts.clear()
        links = 0

    def ends_after(tag: str, place: int) -> bool:
        if tag not in ended:
            ended[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return ended[tag] >= place

    n, search = len(page), _PART.search
    while True:
        m = search(page, at)
        chunk = page[at : m.start() if m else n]
        if chunk and not tree.dropped:
            parts.append(chunk)
            if tree.links:
                links += len(chunk)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m.group(1))
        foreign = tag in ("svg", "math") or (tree.dropped and tree.foreign)
        if foreign and not closing and m.group(3).endswith("/"):
            continue
        if tag in _RAW and not closing:
            end = _RAW_END[tag].search(page, at) if ends_after(tag, at) else None
            at = end.end() if end else n
            if tag != "textarea" and not tree.dropped:
                close()
            continue
        if tree.dropped and tag not in _IN_HEAD and not closing and stack[-1][0] == "head":
            tree.cut(tree.at["head"][0])  # what cannot stand in a head ends it
        if tag == "br" or tag == "hr":
            if tag == "hr" and not tree.dropped:
                close()
            elif not tree.dropped:
                parts.append(" ")
            continue
        if tag in _GOOD_TAG and tree.dropped and not closing:
            # an element that never ends does not hold the main text
            k = min((tree.at[x][0] for x in _EMBED if tree.at.get(x)), default=0)
            if k and not ends_after(stack[k][0], at):
                tree.cut(k)
        if tag not in _INLINE and tag not in ("option", "button") and not tree.dropped:
            close()
        if closing:
            k = tree.find(tag)
            if k and not (tag in _INLINE and stack[-1][4] > stack[k][4]):  # an inline element does not end the blocks that it holds
                tree.cut(k)
            continue
        if tag in _VOID:
            continue
        if tag in _P_CLOSERS and stack[stack[-1][3]][0] == "p":
            tree.cut(stack[-1][3])  # a paragraph ends where the next block starts
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
            tree.cut(len(stack) - 1)
        tree.push(tag, _hint(tag, m.group(3)))
    close()
    for i, b in enumerate(out):
        b.place = (i + 0.5) / len(out)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Of each block, without the names of roles: length, words, links, sentences, tag, place, neighbours."""
    if not blocks:
        return np.zeros((0, 13))
    rows = np.zeros((len(blocks), 13))
    for i, b in enumerate(blocks):
        n = len(b.text)
        ends = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + (b.text[-1] in ".?!")
        rows[i, :11] = (
            1.0, np.log1p(n), b.links / n, np.log1p(ends), b.text[-1] in ".?!:", b.tag in ("p", "blockquote", "pre"),
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "td", "th", "dt", "dd"), "©" in b.text or "|" in b.text or "·" in b.text, b.tag in ("div", "section"), 2 * abs(b.place - 0.5),
        )
    long = rows[:, 1]
    rows[:, 11] = np.concatenate(([0], long[:-1]))
    rows[:, 12] = np.concatenate((long[1:], [0]))
    return rows


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(13)
    if not len(x):
        w[:6] = (-4.0, 1.0, -4.0, 1.0, 0.5, 1.0)  # untrained: long blocks with few links are text
        return w
    side = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (side * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(13)
        step = np.linalg.solve(h, x.T @ (side * (y - p)) - w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-5:
            break
    return w


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut. Augmenting paths of fewest edges (Dinic's phases)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u, v, c, back):
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        add(s, i, source[i] - both, 0.0)
        add(i, t, sink[i] - both, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                path.append(e)
                u = to[e]
            elif u == s:
                break
            else:
                nxt[to[path[-1] ^ 1]] += 1
                u = to[path.pop() ^ 1]


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """True: content. The classifier's log odds, a strong cost for roles by element, a moderate one for roles by name."""
    if not blocks:
        return []
    odds = np.clip(features(blocks) @ weights, -4, 4)
    hint = np.array([b.hint for b in blocks])
    strong = 40.0 * (hint == -2) + NAMED * (hint == -1)
    keep = np.maximum(odds, 0) + 6.0 * (hint > 0)
    drop = np.maximum(-odds, 0) + strong
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i and (blocks[i - 1].hint == -2) == (b.hint == -2):
            edges.append((i - 1, i, NEAR / b.steps))
        j = last.get(b.parent)
        if j is not None and j < i - 1 and (blocks[j].hint == -2) == (b.hint == -2):
            edges.append((j, i, SAME_PARENT))
        last[b.parent] = i
    return minimum_cut(keep.tolist(), drop.tolist(), edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page) if page else []
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights)) if keep)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from at most ``rows`` pages with named roles, those first by a hash of their id."""
    picked = pages.where(F.col(html_col).isNotNull()).orderBy(F.xxhash64(F.lit(5), F.col(id_col)), id_col).limit(rows).select(html_col)
    x, y = [], []
    for r in picked.toLocalIterator():
        blocks = blocks_of(r[0])
        f = features(blocks)
        own = [i for i, b in enumerate(blocks) if b.hint]
        x.append(f[own])
        y += [blocks[i].hint > 0 for i in own]
    return fit(np.concatenate(x) if x else np.zeros((0, 13)), np.array(y, float))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, the blocks of the main text joined by line feeds, and ``n_chars``.

    A null or empty page has the empty text. Unclosed and crossing elements are taken as they come.
    Columns of ``pages`` named text or n_chars are replaced.
    """

    def factory():
        def run(pages):
            texts = [main_text(p, weights) for p in pages.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return run

    return add_columns(pages, [html_col], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], factory, keep)
