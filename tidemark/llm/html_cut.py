"""Main text of web pages by a minimum cut between content and boilerplate blocks.

A page is split into text blocks at block-level tags. A logistic classifier over a block's ancestors, links, length and
punctuation gives the cost of calling it content or boilerplate; these costs are the capacities to the two terminals.
Neighbouring blocks are tied by edges whose capacity falls with their distance in the element tree, both along the page
and to the previous block of the same container. The minimum cut is the labelling of least total cost.

Defined results: a null page is empty; a page without content blocks gives an empty text; scripts, styles, comments and
the head never give blocks; an element, comment or tag that the page never ends runs to its end (an unfinished tag is
dropped); repeated rows are extracted each. Other columns pass through; the added names replace columns of those names.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math select button object video audio canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr"
    " ul".split())
MAIN = frozenset(("article", "main"))
#: Elements that hold what surrounds an article, and words of classes, ids and roles that say so.
AROUND = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "header"))
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments reply replies"
    " respond disqus sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations widget toolbar pager pagination paywall copyright legal hidden search contentinfo"
    " complementary".split())
MAIN_WORDS = frozenset("article content main post story entry body text".split())

#: Weights of the classifier (log odds of content).
WEIGHTS = {"bias": 0.3, "main": 2.5, "main_word": 0.8, "around": -7.0, "around_word": -6.0, "links": -3.0, "words": 0.35,
           "sentence": 0.8, "heading": 0.6, "hidden": -8.0, "mark": -2.0}
#: Capacity between neighbours that share their parent; each step of tree distance halves it.
SMOOTH = 1.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z""",
                    re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "hidden", "has_main")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.words, self.hidden, self.has_main = frozenset(), False, False
        if attributes and "=" in attributes or "hidden" in attributes:
            said = {}
            for name, value in _ATTRIBUTE.findall(attributes):
                said.setdefault(name.lower(), value.strip("\"'"))
            self.words = frozenset(w.lower() for n in ("class", "id", "role") for w in _WORD.findall(said.get(n, "")))
            style = said.get("style", "").replace(" ", "").lower()
            self.hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in style


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _closes_itself(attributes: str | None) -> bool:
    """Whether a tag ends in a slash that is not part of a value without quotes."""
    bare = re.sub("\"[^\"]*\"|'[^']*'", '""', attributes or "")
    return bare.endswith("/") and not re.search(r'=\s*[^\s"]\S*$', bare)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    at = Node("#page", None, "")
    found: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    where, position, end = at, 0, len(page)

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, where, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, where
        if not parts:
            where = at
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    while position < end:
        m = _TOKEN.search(page, position)
        if m is None:
            add(page[position:])
            break
        if m.start() > position:
            add(page[position:m.start()])
        position = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                close_block()
            up = at
            while up.parent is not None and up.tag != name:
                up = up.parent
            if up.parent is not None:
                if name == "a" and links:
                    links -= 1
                at = up.parent
                if name in BLOCK and links:
                    links = _open_links(at)
            continue
        if name in ("svg", "math") and _closes_itself(m[3]):
            parts.append(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, position)
            position = stop.end()
            parts.append(" ")
            continue
        if name in BLOCK:
            close_block()
            if at.tag == "p" or name == at.tag == "li":
                at = at.parent
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        at = Node(name, at, m[3])
        if name == "a":
            links += 1
        elif name in MAIN or name == "h1":
            up = at.parent
            while up is not None and not up.has_main:
                up.has_main = True
                up = up.parent
    close_block()
    return found


def _open_links(node: Node | None) -> int:
    n = 0
    while node is not None:
        n += node.tag == "a"
        node = node.parent
    return n


def log_odds(block: Block) -> float:
    """Log odds that a block is content. An element around the article says nothing of what surrounds it."""
    w = WEIGHTS
    words = block.text.split()
    score = w["bias"] + w["words"] * math.log1p(len(words)) + w["links"] * block.linked / len(block.text)
    score += w["sentence"] * (block.text[-1] in ".!?…\"»”" and len(words) > 4)
    score += w["mark"] * (block.text[0] == "©")
    node, main, around = block.node, 0.0, 0.0
    while node is not None:
        if node.tag in MAIN:
            main = max(main, w["main"])
        elif node.tag[0] == "h" and len(node.tag) == 2:
            score += w["heading"]
        if node.words & MAIN_WORDS:
            main = max(main, w["main_word"])
        if not node.has_main and node.tag not in MAIN and node.tag != "body":
            if node.tag in AROUND:
                around = min(around, w["around"])
            elif node.words & AROUND_WORDS:
                around = min(around, w["around_word"])
        if node.hidden:
            around = w["hidden"]
        node = node.parent
    return score + main + around


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the vertices on the source's side of a minimum cut: shortest augmenting paths by level (Dinic)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(u: int, v: int, forth: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            connect(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            connect(i, t, sink[i] - both, 0.0)
    for u, v, c in edges:
        connect(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                first = next(i for i, e in enumerate(path) if room[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while nxt[u] < len(out[u]):
                e = out[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                nxt[u] = len(out[u])
                u = to[path.pop() ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def label(found: list[Block]) -> list[bool]:
    """True for content blocks."""
    keep, drop, edges = [], [], []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        p = min(max(1 / (1 + math.exp(-log_odds(block))), 1e-4), 1 - 1e-4)
        keep.append(-math.log(1 - p))  # paid if called boilerplate
        drop.append(-math.log(p))
        if i:
            edges.append((i - 1, i, SMOOTH / 2 ** distance(found[i - 1].node, block.node)))
        parent = id(block.node.parent)
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SMOOTH / 2 ** distance(found[last[parent]].node, block.node)))
        last[parent] = i
    return [not x for x in minimum_cut(drop, keep, edges)] if found else []


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks, number of content blocks."""
    found = blocks_of(page or "")
    kept = [b.text for b, good in zip(found, label(found)) if good]
    return " ".join(kept), len(found), len(kept)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()),
                        T.StructField("n_content", T.IntegerType())])


@F.pandas_udf(_RESULT)
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([main_text(p) for p in batch], columns=["text", "n_blocks", "n_content"])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, ``n_blocks`` and ``n_content`` of every page."""
    done = pages.withColumn("_main", _extract(F.col(column)))
    return done.withColumns({n: F.col(f"_main.{n}") for n in _RESULT.names}).drop("_main")
