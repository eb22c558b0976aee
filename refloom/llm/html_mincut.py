"""Main text of web pages by minimum cut.

A page is cut into blocks at its block-level tags. A linear classifier over tag, container, class names, length, links and
punctuation gives each block a probability of being content; the two negative log probabilities are its terminal
capacities. Blocks that follow each other, and blocks that follow each other within the same container, are tied by
smoothness edges that weaken with the distance between them in the DOM. The maximum flow from content to boilerplate
separates the page: what the cut leaves on the content side is the main text.

One page is one task's small graph (two edges per block), whatever the number of pages; nothing is shuffled. Tags are read
in one pass with a stack of open elements, as browsers repair them: a paragraph ends where the next begins, a closing
tag without an opening one is dropped, an open tag at the end of the page counts for nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of HTML: tags that stay within a block, that have no content, and whose content is no text of the page.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template svg math iframe object select textarea title head canvas audio video".split())
RAW = set("script style textarea title noscript iframe".split())
#: A new element of the key ends an open one of these, up to the nearest container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "html", "td", "th", "form", "aside", "nav"}

#: Containers that hold no main text, by tag, by role, and by words of class and id.
BAD_TAGS = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist disqus "
    "reply replies discussion widget pagination pager skip form copyright legal disclaimer".split()
)
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "discussion"}
GOOD_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "maintext", "articlebody"}

#: Weights of the classifier.
WEIGHTS = {
    "bias": -0.5, "article": 4.0, "good": 2.0, "bad": -9.0, "p": 1.0, "heading": 0.5, "li": -0.3, "words": 0.6, "sentence": 0.8, "links": -4.0, "rights": -3.0,
}
#: Strength of the edges between blocks one step apart in the DOM, and by which factor each further step weakens them.
TIE, FADE = 1.0, 0.7

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|copyright", re.I)
_SENTENCE = (".", "!", "?", "…", ":", ";", "。", "！", "？", '."', ".”", ".)")


@dataclass(slots=True)
class Element:
    tag: str
    depth: int
    parent: Element | None
    dropped: bool
    bad: bool
    comment: bool
    article: bool
    good: bool


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    links: int


def _opened(tag: str, attributes: str, parent: Element) -> Element:
    words, role, article = set(), "", tag in ("article", "main")
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "role":
                role = value.lower()
            elif name.lower() == "itemprop":
                article = article or value.lower() == "articlebody"
            elif tag not in ("html", "body"):
                words.update(w.lower() for w in _NAME_WORDS.findall(value))
    article = article or role in ("main", "article")
    comment = parent.comment or bool(words & COMMENT_WORDS)
    good = bool(words & GOOD_WORDS)
    named_bad = bool(words & BAD_WORDS) and not good or bool(words & COMMENT_WORDS)
    bad_here = tag in BAD_TAGS or role in BAD_ROLES or named_bad or (tag == "header" and not parent.article)
    # The article itself may stand in a frame whose name speaks of a sidebar or a banner.
    bad = bad_here or (parent.bad and not (article and not comment))
    return Element(
        tag, parent.depth + 1, parent, parent.dropped or tag in DROPPED, bad, comment, parent.article or article, parent.good or good
    )


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order."""
    root = Element("", 0, None, False, False, False, False, False)
    stack, out, buffer, links = [root], [], [], 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                element = stack[-1]
                while element.tag in INLINE and element.parent is not None:
                    element = element.parent
                out.append(Block(text, element, links))
            buffer.clear()
            links = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        for e in stack[k:]:
            in_link -= e.tag == "a"
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        end = m.start() if m else size
        if end > at and not stack[-1].dropped:
            piece = html.unescape(page[at:end])
            buffer.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            if tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if tag in INLINE:
                buffer.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        ends = ENDS.get(tag, {"p"} if tag in ENDS_P else ())
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    pop_to(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag == "body":
            while len(stack) > 1 and stack[-1].dropped:
                pop_to(len(stack) - 1)
        if tag not in INLINE:
            flush()
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if not attributes.endswith("/") or tag in INLINE or tag in ("div", "p"):
            stack.append(_opened(tag, attributes, stack[-1]))
            in_link += tag == "a"
    flush()
    return out


def score(block: Block, weights: dict[str, float] = WEIGHTS) -> float:
    """Log odds of being content."""
    e, n = block.element, block.text.count(" ") + 1
    s = weights["bias"] + weights["words"] * min(math.log1p(n), 5.0)
    s += weights["links"] * block.links / len(block.text)
    if e.article:
        s += weights["article"]
    if e.good:
        s += weights["good"]
    if e.bad:
        s += weights["bad"]
    if e.tag in ("p", "blockquote", "pre", "figcaption"):
        s += weights["p"]
    elif len(e.tag) == 2 and e.tag[0] == "h":
        s += weights["heading"]
    elif e.tag == "li":
        s += weights["li"]
    if block.text.endswith(_SENTENCE):
        s += weights["sentence"]
    if n < 30 and _RIGHTS.search(block.text):
        s += weights["rights"]
    return s


def _steps(a: Element, b: Element) -> int:
    """Steps between two elements in the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def ties(blocks: list[Block], tie: float = TIE, fade: float = FADE) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the block before, and to the last block that hung on the same container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, tie * fade ** _steps(blocks[i - 1].element, b.element)))
        container = id(b.element.parent)
        if last.get(container, i - 1) < i - 1:
            edges.append((last[container], i, tie * fade**2))
        last[container] = i
    return edges


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of the minimum cut for log odds and symmetric edges, by Dinic's maximum flow.

    Only the difference of a block's two terminal capacities matters, and it is the log odds. A tie goes to content.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s >= 0:
            edge(source, i, s, 0.0)
        else:
            edge(i, sink, -s, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    least = 1e-12
    while True:
        # From the sink backwards, so that what cannot reach the sink any more stays with the content.
        level = [-1] * (n + 2)
        level[sink] = 0
        queue = deque([sink])
        while queue:
            v = queue.popleft()
            for k in out[v]:
                if level[to[k]] < 0 and room[k ^ 1] > least:
                    level[to[k]] = level[v] + 1
                    queue.append(to[k])
        if level[source] < 0:
            return [level[i] < 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[k] for k in path)
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow
                back = next(j for j, k in enumerate(path) if room[k] <= least)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while place[v] < len(out[v]):
                k = out[v][place[v]]
                if room[k] > least and level[to[k]] == level[v] - 1:
                    break
                place[v] += 1
            else:
                if v == source:
                    break
                v = to[path.pop() ^ 1]
                place[v] += 1
                continue
            path.append(k)
            v = to[k]


def main_text(page: str | None) -> str:
    """Text of the content blocks, joined by line feeds; "" for a null or empty page or one without content."""
    if not page:
        return ""
    blocks = blocks_of(page)
    labels = cut([score(b) for b in blocks], ties(blocks))
    return "\n".join(b.text for b, kept in zip(blocks, labels, strict=True) if kept)


@pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype="object")


def extract(page: Column) -> Column:
    """Main text of a column of HTML."""
    return _main_texts(page)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row: the main text of the whole page and its length in code points.

    Null, empty and contentless pages have the empty text; an empty table gives no rows; pages of any length are read whole. Repeated rows, null ids and null addresses keep their rows; other
    columns are ignored, whatever their names.
    """
    out = pages.select(id_col, url_col, extract(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
