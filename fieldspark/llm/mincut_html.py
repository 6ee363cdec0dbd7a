"""Main text of web pages by minimum-cut labelling of their blocks.

Method. A page is cut into blocks of text at block-level tags. A linear classifier over
tag, place in the tree, length, links and punctuation gives each block a cost for either
label, which is the capacity of its edge to the source (content) or the sink
(boilerplate). Smoothness edges join blocks that follow each other and blocks that are close
in the tree (one parent, one grandparent), the stronger the closer. A maximum flow
separates the two sides; blocks on the source side are the main text. Blocks whose
own costs outweigh all their edges are settled first (their label is the same in
every minimum cut), so flows run over what is left, mostly a few blocks.

Names of classes are bounded evidence: a name for a layout part is set aside for an element that holds the article or most of the page's prose; a state ("comments-open") or a topic ("tag-news") says nothing, a name for content
outweighs a weak name against it in the same element, and long text outweighs weak names ("notice", "social"). A form hides its
controls, and the rest of it has a bounded cost, as some sites wrap whole pages in one. Scripts, styles, comments
in the markup, controls and the head never become blocks; a block of nothing but buttons is a control too. Character references are
decoded, white space inside a block is one space, blocks are joined by an empty line.

Edge cases. A null or empty page, or one without content, gives an empty text. Tags
that are never closed end with their parent; what is left of a cut-off tag at the end is
not text. Pages of any length are taken whole. Repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br button math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded semantics".split())
HIDDEN = frozenset("head title script style noscript template svg annotation iframe object canvas select textarea datalist dialog audio video".split())
ASIDE = frozenset("nav footer aside header menu".split())
CLOSES_P = frozenset("p div ul ol dl li table h1 h2 h3 h4 h5 h6 section article header footer nav aside main pre blockquote form hr figure address fieldset".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names of layout parts, and of what lies over or after an article.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:ads?|nav\w*|menu\w*|breadcrumbs?|sidebar|aside|footer|subscribe|login|signup|search|pagination|pager|toolbar|skip)(?=$|[\s_-])", re.I)
APART = re.compile(
    r"(?:^|[\s_-])(?:advert\w*|cookies?|consent|gdpr|popup|modal|newsletter|comments?|respond|replies|disqus|discussion|threads?|reactions|copyright|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
WEAK = re.compile(r"(?:^|[\s_-])(?:banner|promo\w*|sponsor\w*|notices?|share|social|related|recommend\w*|widget|tags?|legal)(?=$|[\s_-])", re.I)
SILENT = re.compile(r"(?:^|\s)(?:\S*[_-](?:open|opened|closed|enabled|disabled|on|off|allowed|active|hidden)|(?:tag|category|topic)-\S+)(?=$|\s)", re.I)
SITE_HINTS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?=$|[\s_-])", re.I)  # inside an article they name its own heading
HINTS_FOR = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """An open element: its tag, number, and what it and its parents say about its text."""

    __slots__ = ("against", "apart", "favour", "form", "holds", "layout", "names", "number", "parent", "hidden", "prose", "tag", "weak")

    def __init__(self, tag: str, number: int, parent: Node | None, names: str):
        self.tag, self.number, self.parent = tag, number, parent
        self.hidden = tag in HIDDEN or (parent is not None and parent.hidden)
        self.form = tag == "form" or (parent is not None and parent.form)
        self.names = SILENT.sub(" ", names) if names and tag not in ("html", "body", "article", "main") else ""
        self.layout = self.names != "" and LAYOUT.search(self.names) is not None
        self.apart = self.names != "" and APART.search(self.names) is not None
        #: Characters of prose inside, and whether it holds an article (1), or the main part or heading of the page (2).
        self.prose, self.holds = 0, 0
        self.against, self.favour, self.weak = 0, 0.0, 0

    def judge(self, prose: int) -> None:
        """Evidence from the parent, which is judged before, and from its own tag and names; prose is that of the page.

        A name for a layout part of an element that holds the article, the page's heading or more than half of its prose tells how the page is laid out, not
        what the element is ("has-sidebar", "menu-page"); one for comments or notices is set aside for the main part or heading only.
        """
        up, names = self.parent, self.names
        inside = up is not None and up.favour >= 2.5
        self.favour = max(up.favour if up else 0.0, 2.5 if self.tag == "article" else 2.0 if self.tag == "main" else 0.0)
        self.against, self.weak = (up.against, up.weak) if up else (0, 0)
        if self.tag in ASIDE and not (self.tag == "header" and inside):
            self.against += 1
        if not names:
            return
        strong = self.apart and self.holds < 2 or self.layout and not self.holds and 2 * self.prose <= prose
        if strong or not inside and SITE_HINTS.search(names) and 2 * self.prose <= prose:
            self.against += 1
        elif HINTS_FOR.search(names):
            self.favour = max(self.favour, 1.5)
        elif WEAK.search(names):
            self.weak = 1


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, element, characters inside links) of every block of a page, in page order."""
    out: list[tuple[str, Node, int]] = []
    root = Node("#page", 0, None, "")
    stack, made, every = [root], 0, [root]
    parts: list[str] = []
    linked, link_depth, at = 0, 0, 0
    pressed, inside_button = 0, False

    def flush() -> None:
        nonlocal linked, pressed
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and pressed < len(text):
                out.append((text, stack[-1], min(linked, len(text))))
        linked = pressed = 0

    for token in TOKEN.finditer(page):
        if token.start() > at and not stack[-1].hidden:
            piece = entities.unescape(page[at : token.start()])
            if not inside_button or not stack[-1].form:
                parts.append(piece)
            if link_depth:
                linked += len(piece)
            if inside_button:
                pressed += len(piece)
        at = token.end()
        end, tag, rest = token[2] or token[5], token[3] or token[6], token[4] or token[7] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if end else 1))
            elif tag == "br":
                parts.append(" ")
            elif tag == "button":
                inside_button = not end
            continue
        flush()
        link_depth, inside_button = 0, False
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if stack[-1].tag in SELF_CLOSING.get(tag, ()):
            stack.pop()
            if tag == "tr" and stack[-1].tag == "tr":
                stack.pop()
        if tag not in VOID:
            made += 1
            names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if rest else ""
            stack.append(Node(tag, made, stack[-1], names))
            every.append(stack[-1])
    if at < len(page) and not stack[-1].hidden:
        parts.append(entities.unescape(page[at:]))
    flush()
    out = [b for b in out if not b[1].hidden]
    for text, node, link in out:
        if len(text) > 120 and 2 * link < len(text):
            node.prose += len(text)
    for node in reversed(every):  # children have greater numbers than their parents
        node.holds = max(node.holds, {"article": 1, "main": 2, "h1": 2}.get(node.tag, 0))
        if node.parent is not None:
            node.parent.prose += node.prose
            # The heading of a comment or of an aside is not the page's.
            node.parent.holds = max(node.parent.holds, 0 if node.tag in ASIDE else node.holds)
    for node in every:
        node.judge(root.prose)
    return out


def leaning(text: str, node: Node, linked: int) -> float:
    """Log odds of content: over zero for it."""
    stop = text[-1] in ".!?:;\"”»)…"
    prose = stop and node.tag == "p" and len(text) > 120  # a paragraph may be a link as a whole
    score = -0.8 + node.favour - 5.0 * node.against - (2.0 if node.weak else 0.0) - (1.0 if node.form else 0.0) - (1.5 if prose else 4.0) * linked / len(text)
    length = max(-1.5, min(2.0, math.log(len(text) / 40) * 0.8))
    score += length if length > 0 or node.favour < 1.5 else 0.3 * length  # short blocks are usual inside an article
    if node.tag in ("p", "blockquote", "pre"):
        score += 1.0
    elif node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 0.8
    elif node.tag in ("li", "td", "th"):
        score -= 0.3
    if stop:
        score += 0.7
    return score


def _pairs(found: list[tuple[str, Node, int]]) -> dict[tuple[int, int], float]:
    """Smoothness edges: neighbours on the page, then neighbours under one parent and one grandparent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for i, (_, node, _) in enumerate(found):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + (0.5 if found[i - 1][1].against == node.against and found[i - 1][1].weak == node.weak else 0.1)
        up = node
        for height, weight in ((1, 0.8), (2, 0.4)):
            up = up.parent or up
            j = last.get((height, up.number))
            if j is not None:
                edges[j, i] = edges.get((j, i), 0.0) + (weight if found[j][1].against == node.against else weight / 8)
            last[height, up.number] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each place is on the source's side of the smallest minimum cut (ties go to the sink)."""
    n = len(source)
    source, sink = list(source), list(sink)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # places whose own costs outweigh their edges
        i = todo.popleft()
        if side[i] is not None:
            continue
        own = source[i] - sink[i]
        if abs(own) <= sum(near[i].values()) + 1e-12 and near[i]:
            continue
        side[i] = own > 0
        for j, w in near[i].items():
            if own > 0:
                source[j] += w
            else:
                sink[j] += w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(x) for x in side]
    s, t = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
    room[s], room[t] = {}, {}
    for i in left:
        d = source[i] - sink[i]
        room[s][i], room[i][s] = max(d, 0.0), 0.0
        room[i][t], room[t][i] = max(-d, 0.0), 0.0
    while True:
        seen, queue = {s: s}, deque([s])
        while queue and t not in seen:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in seen:
                    seen[j] = i
                    queue.append(j)
        if t not in seen:
            break
        path, j = [], t
        while j != s:
            path.append((seen[j], j))
            j = seen[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] += flow
    for i in left:
        side[i] = i in seen
    return [bool(x) for x in side]


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by an empty line."""
    found = blocks(page or "")
    if not found:
        return ""
    score = [leaning(*b) for b in found]
    keep = minimum_cut([math.log1p(math.exp(min(x, 50))) for x in score], [math.log1p(math.exp(min(-x, 50))) for x in score], _pairs(found))
    return "\n\n".join(b[0] for b, good in zip(found, keep, strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            text = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of pages; no exchange."""
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = own.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
