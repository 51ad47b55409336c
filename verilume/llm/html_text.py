"""Main text of HTML pages.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of the blocks before and after
it, and where it stands: inside or outside the page's article or main element, in a heading or a list item, and how strongly the
elements around it say that they are something else (`hint`: 2 for navigation, footer, aside, form and the like, by element, role
or a whole class name; 1 for a class name of which a part says so; 0 for neither). A decision tree, grown from the small
labelled table EXAMPLES by Gini impurity, keeps or drops each block. Kept blocks are joined in page order by an empty line.

A hint counts only where it can be meant: not for an element that holds the page's largest article or, a form, most of its text
(that is layout). An inline element with a hint inside a block is decided on its own, and the rest of the block stays together.

Scripts, styles, comments, markup and invisible elements never become blocks. White space inside a block becomes one space;
character references are decoded once. Nothing is cut off. Pages are read once from left to right, in time linear in their length:
end tags may be missing, a tag that never ends is no text, and an element that hides its text does so only if it is closed.

Defined results: a null or empty page gives an empty text; text without any markup is one block; unclosed and stray tags are
tolerated; repeated rows give repeated rows; null ids and urls are returned as they are; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilume.llm.common import map_texts

#: Elements of HTML by what they do to text.
RAW = set("script style iframe noembed noframes xmp textarea".split())
UNSEEN = set("title noscript template svg math object canvas select button datalist audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    (
        "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
        "thead title tr ul"
    ).split()
)
PARTS = set("nav footer aside form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: An element of the first kind ends an open one of the second kind, if that is inside the innermost of the third.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr", "table"),
    "td": ("td th", "table tr"),
    "th": ("td th", "table tr"),
    "option": ("option", "select"),
}
#: Words in classes and ids of what isn't the article, and words that make a class name one of the layout.
MARKS = set(
    (
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation "
        "menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
        "overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations "
        "comment comments reply replies disqus respond pagination pager widget widgets toolbar search disclaimer paywall"
    ).split()
)
LAYOUT = set("with has no not without is layout".split())

_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTED = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_ARTICLE = {"article", "main"}


@dataclass
class Element:
    tag: str
    attrs: str = ""
    parent: Element | None = None
    closed: bool = False
    words: int = 0
    own: int = 0
    hint: int = 0
    inline_hint: int = 0
    unseen: bool = False
    article: bool = False
    heading: bool = False
    item: bool = False


@dataclass
class Block:
    """A run of text between block boundaries. aside: it is an inline part with a hint of its own inside the block `line`."""

    line: int
    text: str
    words: int
    linked: int
    hint: int
    inside: bool
    heading: bool
    item: bool
    aside: bool = False
    pieces: list = field(default_factory=list)


def _tag_end(page: str, at: int) -> int:
    """The place after the > that ends the tag; -1 if none does. Quotes count only as a value's first character and if closed."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.end()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", m.end()) + 1 or -1
        at = close + 1


def _pieces(page: str):
    """(text, None, "") for text, (tag, True, attributes) for a start tag, (tag, False, "") for an end tag, in page order."""
    at, open_comments = 0, True
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            yield page[at : m.start()], None, ""
        if m[2] is None:
            end = page.find("-->", m.end()) if open_comments and page.startswith("<!--", m.start()) else -2
            open_comments &= end != -1
            at = end + 3 if end >= 0 else page.find(">", m.end()) + 1
            if not at:
                return
            continue
        tag, at = m[2].lower(), _tag_end(page, m.end())
        if at < 0:
            return
        if m[1]:
            yield tag, False, ""
            continue
        attrs = page[m.end() : at - 1]
        yield tag, True, attrs
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = _tag_end(page, close.end()) if close else -1
            if at < 0:
                return
            yield tag, False, ""
    if at < len(page):
        yield page[at:], None, ""


class _Reader:
    """The elements of a page and its pieces of text, each with the element that it is in and the line (block) it is part of."""

    def __init__(self, page: str):
        self.stack: list[Element] = [Element("")]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks_at: list[int] = [0]
        self.texts: list[tuple[int, str, Element, int, bool]] = []
        self.elements: list[Element] = []
        self.line = self.links = 0
        for what, opens, attrs in _pieces(page):
            if opens is None:
                self._text(what)
            elif opens:
                self._open(what, attrs)
            else:
                self._close(what)

    def _text(self, text: str) -> None:
        text = html.unescape(text)
        words = len(text.split())
        self.stack[-1].words += words
        self.texts.append((self.line, text, self.stack[-1], words, self.links > 0))

    def _pop(self, closed: str | None = None) -> None:
        e = self.stack.pop()
        if self.places[e.tag] and self.places[e.tag][-1] == len(self.stack):
            self.places[e.tag].pop()
        if self.blocks_at[-1] == len(self.stack):
            self.blocks_at.pop()
        self.links -= e.tag == "a"
        e.closed = e.tag == closed
        self.stack[-1].words += e.words

    def _last(self, tags: str) -> int:
        return max((self.places[t][-1] for t in tags.split() if self.places[t]), default=0)

    def _pop_to(self, at: int, closed: str | None = None) -> None:
        while len(self.stack) > at + 1:
            self._pop()
        self._pop(closed)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.line += 1
            if self.stack[self.blocks_at[-1]].tag == "p":
                self._pop_to(self.blocks_at[-1], "p")
        elif tag == "br":
            self.texts.append((self.line, " ", self.stack[-1], 0, False))
        if tag in ENDS:
            own, within = ENDS[tag]
            if (at := self._last(own)) > self._last(within):
                self._pop_to(at, self.stack[at].tag)
        if tag == "a" and self.places["a"]:
            self._close("a")
        if tag in VOID or (attrs.endswith("/") and (tag in ("svg", "math") or self._last("svg math"))):
            return
        e = Element(tag, attrs, self.stack[-1])
        self.elements.append(e)
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks_at.append(len(self.stack))
        self.stack.append(e)
        self.links += tag == "a"

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self.line += 1
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        if tag not in BLOCK and at < self.blocks_at[-1]:  # an inline element around blocks: it ends, they don't
            self.places[tag].pop()
            self.stack[at].closed, self.stack[at].tag = True, f"/{tag}"
            self.links -= tag == "a"
            return
        self._pop_to(at, tag)

    def finish(self) -> None:
        while len(self.stack) > 1:
            self._pop()
        total = self.stack[0].words
        for e in self.elements:  # parents come before their children
            up, tag = e.parent, e.tag.removeprefix("/")
            e.unseen = up.unseen or tag in RAW or (tag in UNSEEN and e.closed)
            e.article = up.article or tag in _ARTICLE
            e.heading = up.heading or tag in _HEADINGS
            e.item = up.item or tag == "li"
            e.own = 0 if tag in ("html", "body") or (tag == "form" and 2 * e.words > total) else hint(tag, e.attrs, up.article)
            e.hint = max(up.hint, e.own)
        articles = [e for e in self.elements if e.tag.removeprefix("/") in _ARTICLE]
        holder = max(articles, key=lambda e: (e.hint == 0, e.words), default=None)
        while holder:
            holder.own, holder = 0, holder.parent
        for e in self.elements:
            up = e.parent
            block = e.tag in BLOCK
            e.hint, e.inline_hint = (max(up.hint, e.own), 0) if block else (up.hint, max(up.inline_hint, e.own))


def hint(tag: str, attrs: str, in_article: bool) -> int:
    """How strongly an element says that it isn't the article's text."""
    if tag in PARTS or (tag == "header" and not in_article):
        return 2
    found = 0
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return 2
        if name == "role" and value.lower() in ROLES:
            return 2
        if name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _PARTED.split(one) if p]
                if not parts or parts[0] in LAYOUT:
                    continue
                if all(p in MARKS for p in parts):
                    return 2
                found |= parts[0] in MARKS or parts[-1] in MARKS
    return int(found)


def blocks(page: str | None) -> list[Block]:
    reader = _Reader(page or "")
    reader.finish()
    lines: dict[tuple[int, bool], list] = {}
    for line, text, e, words, linked in reader.texts:
        if not e.unseen:
            lines.setdefault((line, e.inline_hint > 0), []).append((text, e, words, linked))
    out = []
    for (line, aside), pieces in lines.items():
        text = " ".join("".join(p[0] for p in pieces).split())
        if text:
            e = next(p[1] for p in pieces if p[0].strip())
            linked = sum(p[2] for p in pieces if p[3])
            out.append(Block(line, text, len(text.split()), linked, max(e.hint, e.inline_hint), e.article, e.heading, e.item, aside))
    whole = {b.line: b for b in out if not b.aside}
    if any(b.aside for b in out):
        for line, text, e, _, _ in reader.texts:
            if line in whole and not e.unseen:
                whole[line].pieces.append((text, e.inline_hint > 0))
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hint", "place", "heading", "item")

#: The labelled table: FEATURES and whether the block is main text. links: share of words in links; place: 1 inside the article, -1
#: outside it, 0 if the page has none; heading, item: 0 or 1.
EXAMPLES = """
4 1.00 275 0.00 5 1.00 0 1 1 0 yes
6 0.00 121 1.00 15 0.00 0 1 1 0 yes
7 0.93 254 0.00 233 1.00 0 1 1 0 yes
7 1.00 28 0.56 21 0.00 0 1 1 0 yes
14 0.00 7 0.00 163 0.00 0 1 1 0 yes
15 1.00 22 0.00 219 1.00 0 1 1 0 yes
24 1.00 296 0.00 7 0.00 0 1 1 0 yes
26 0.00 5 0.00 5 0.00 0 1 1 0 yes
121 0.78 7 0.00 1 0.00 0 1 1 0 yes
156 0.60 149 0.00 177 0.00 0 1 1 0 yes
240 1.00 233 0.00 142 1.00 0 1 1 0 yes
247 1.00 17 1.00 12 1.00 0 1 1 0 yes
2 0.00 121 1.00 5 1.00 0 1 0 0 yes
2 0.63 79 1.00 26 1.00 0 1 0 1 yes
2 1.00 0 0.00 15 0.28 0 1 0 0 yes
3 0.00 2 0.11 205 0.00 0 1 0 0 yes
3 0.00 5 1.00 17 1.00 0 1 0 0 yes
3 0.59 100 1.00 22 1.00 0 1 0 0 yes
4 1.00 12 0.88 184 0.00 0 1 0 0 yes
5 0.71 37 0.00 79 1.00 0 1 0 0 yes
7 0.00 205 1.00 5 0.00 0 1 0 0 yes
7 1.00 17 0.00 170 1.00 0 1 0 0 no
7 1.00 15 1.00 7 1.00 0 1 0 0 no
9 1.00 268 0.00 13 1.00 0 1 0 0 no
9 1.00 212 0.00 8 1.00 0 1 0 1 no
10 0.00 0 0.00 19 1.00 0 1 0 1 yes
10 0.35 275 1.00 100 0.00 0 1 0 1 yes
10 1.00 212 0.55 10 0.00 0 1 0 1 yes
11 0.00 275 0.92 9 1.00 0 1 0 0 yes
11 0.00 19 1.00 27 1.00 0 1 0 0 yes
11 0.00 28 1.00 191 0.00 0 1 0 0 yes
11 0.12 27 0.00 28 0.00 0 1 0 0 yes
12 0.00 11 1.00 79 0.00 0 1 0 1 yes
16 1.00 2 0.00 19 0.00 0 1 0 0 yes
19 0.48 128 1.00 1 0.00 0 1 0 0 yes
19 1.00 29 0.00 3 0.07 0 1 0 0 yes
20 0.73 240 1.00 12 0.78 0 1 0 0 yes
20 1.00 22 0.00 12 0.00 0 1 0 0 yes
21 1.00 114 1.00 23 0.00 0 1 0 0 no
22 1.00 2 0.00 23 0.00 0 1 0 1 yes
22 1.00 10 0.00 24 0.00 0 1 0 0 yes
24 0.90 15 0.00 282 1.00 0 1 0 0 no
26 0.00 16 0.00 93 0.00 0 1 0 1 yes
26 0.97 0 0.00 12 1.00 0 1 0 0 no
26 1.00 22 1.00 19 0.00 0 1 0 0 no
27 0.00 4 0.00 5 0.00 0 1 0 0 yes
27 1.00 8 0.00 93 1.00 0 1 0 0 no
28 1.00 10 0.68 254 0.00 0 1 0 0 yes
29 0.00 24 1.00 20 1.00 0 1 0 0 yes
58 0.92 156 0.00 0 0.00 0 1 0 0 yes
65 1.00 282 0.94 12 0.00 0 1 0 1 no
79 0.89 13 0.00 26 1.00 0 1 0 0 yes
100 0.00 12 1.00 0 0.00 0 1 0 0 yes
100 0.00 296 0.00 121 1.00 0 1 0 1 yes
114 0.72 29 0.00 4 1.00 0 1 0 1 yes
114 1.00 22 1.00 289 0.00 0 1 0 0 no
128 1.00 289 1.00 20 1.00 0 1 0 0 no
135 1.00 3 0.00 7 0.00 0 1 0 1 yes
142 0.00 4 0.27 0 0.00 0 1 0 0 yes
149 0.00 177 1.00 0 0.00 0 1 0 0 yes
149 1.00 19 0.00 22 1.00 0 1 0 0 no
170 1.00 26 0.00 226 0.47 0 1 0 1 yes
177 0.00 93 0.00 22 0.00 0 1 0 0 yes
191 0.71 1 0.00 0 0.00 0 1 0 0 yes
205 1.00 18 0.00 3 0.00 0 1 0 0 yes
219 1.00 2 1.00 23 0.00 0 1 0 0 no
226 0.00 29 1.00 5 1.00 0 1 0 0 yes
233 0.50 261 1.00 3 0.00 0 1 0 1 yes
233 0.93 296 1.00 24 1.00 0 1 0 0 no
240 0.00 3 1.00 7 1.00 0 1 0 1 yes
247 0.00 8 0.00 93 1.00 0 1 0 0 yes
254 1.00 128 0.56 170 0.83 0 1 0 0 yes
275 1.00 0 0.00 1 0.00 0 1 0 0 yes
275 1.00 128 1.00 0 0.00 0 1 0 0 no
282 1.00 30 0.00 93 0.00 0 1 0 0 yes
296 1.00 29 0.00 114 0.73 0 1 0 0 yes
3 0.00 142 0.35 156 0.00 1 1 0 1 no
5 1.00 30 0.00 219 0.00 1 1 0 0 no
6 1.00 6 0.00 226 0.00 1 1 0 0 no
27 0.00 26 0.00 24 0.00 1 1 0 0 yes
254 0.00 19 0.00 23 0.00 1 1 0 1 yes
18 0.99 3 1.00 4 0.39 2 1 1 0 no
5 0.00 27 0.00 16 0.00 2 1 0 0 no
6 0.00 18 1.00 51 0.23 2 1 0 1 no
22 0.75 28 0.50 12 0.00 2 1 0 0 no
27 0.00 2 1.00 7 0.00 2 1 0 1 no
30 1.00 86 0.00 17 0.00 2 1 0 0 no
128 1.00 24 1.00 15 0.67 2 1 0 0 no
191 0.76 121 0.48 65 0.00 2 1 0 0 no
205 0.00 14 0.91 12 0.00 2 1 0 0 no
275 0.00 26 0.93 0 0.00 2 1 0 0 no
5 0.00 8 1.00 177 1.00 0 0 1 0 yes
8 0.51 44 0.00 296 0.00 0 0 1 0 yes
18 0.94 205 0.00 268 0.00 0 0 1 0 no
19 1.00 12 0.00 12 0.00 0 0 1 0 no
29 0.73 24 0.00 0 0.00 0 0 1 0 yes
79 1.00 184 1.00 1 0.00 0 0 1 0 no
1 0.00 80 1.00 35 1.00 0 0 0 1 no
1 0.00 163 0.00 11 1.00 0 0 0 0 yes
1 0.00 1 0.00 1 1.00 0 0 0 0 yes
1 0.00 24 1.00 22 0.72 0 0 0 0 no
3 0.00 2 1.00 6 1.00 0 0 0 1 no
3 0.00 2 0.00 90 1.00 0 0 0 0 yes
3 0.00 40 1.00 90 0.00 0 0 0 1 yes
3 0.00 2 1.00 35 1.00 0 0 0 1 no
3 0.00 40 1.00 2 1.00 0 0 0 0 no
3 0.00 5 1.00 35 0.00 0 0 0 0 yes
3 1.00 1 0.00 1 0.00 0 0 0 1 no
3 1.00 5 0.00 90 0.00 0 0 0 1 no
3 1.00 40 0.00 1 0.00 0 0 0 1 no
4 0.00 80 1.00 6 0.00 0 0 0 0 yes
4 1.00 40 0.00 35 0.00 0 0 0 0 yes
6 0.10 198 1.00 163 1.00 0 0 0 1 no
8 0.00 2 1.00 0 0.00 0 0 0 0 yes
9 0.00 1 0.00 6 1.00 0 0 0 0 yes
9 0.00 5 1.00 90 0.00 0 0 0 1 yes
9 0.00 1 1.00 2 1.00 0 0 0 0 no
9 1.00 80 1.00 90 1.00 0 0 0 0 no
9 1.00 80 0.00 2 0.00 0 0 0 0 no
11 0.00 29 1.00 296 1.00 0 0 0 0 no
11 0.71 86 0.95 0 0.00 0 0 0 0 no
12 1.00 247 0.00 12 0.00 0 0 0 1 yes
13 0.00 22 0.98 142 1.00 0 0 0 0 no
13 0.00 5 1.00 90 1.00 0 0 0 0 no
13 0.00 2 1.00 35 0.00 0 0 0 1 yes
13 0.00 80 0.00 2 1.00 0 0 0 0 yes
13 0.00 261 1.00 219 0.00 0 0 0 0 yes
13 1.00 40 0.00 35 1.00 0 0 0 0 no
13 1.00 5 0.00 2 1.00 0 0 0 1 no
13 1.00 80 0.00 2 0.00 0 0 0 1 no
13 1.00 86 0.00 163 0.33 0 0 0 0 no
14 0.27 3 1.00 184 1.00 0 0 0 0 no
14 1.00 226 0.46 121 0.00 0 0 0 0 no
15 0.00 72 1.00 72 1.00 0 0 0 0 yes
15 1.00 233 1.00 29 0.00 0 0 0 0 no
16 1.00 28 0.00 29 0.14 0 0 0 0 yes
16 1.00 16 0.00 72 0.00 0 0 0 1 yes
18 0.35 5 0.00 219 0.60 0 0 0 0 no
18 1.00 25 0.00 184 0.00 0 0 0 0 yes
19 1.00 11 0.00 18 0.00 0 0 0 1 yes
19 1.00 2 0.00 191 0.00 0 0 0 0 no
20 0.28 17 1.00 6 0.00 0 0 0 0 yes
21 1.00 19 0.00 25 0.03 0 0 0 0 yes
22 1.00 296 0.00 0 0.00 0 0 0 0 no
24 0.67 10 0.00 135 1.00 0 0 0 0 no
24 1.00 51 0.00 10 0.00 0 0 0 0 yes
25 0.64 1 1.00 8 0.00 0 0 0 1 no
27 0.00 5 0.00 240 0.00 0 0 0 0 yes
27 1.00 205 0.00 205 0.97 0 0 0 1 no
27 1.00 10 0.00 240 0.00 0 0 0 1 yes
29 0.69 156 0.07 15 0.00 0 0 0 1 yes
29 1.00 0 0.00 121 0.00 0 0 0 0 no
29 1.00 29 0.00 198 1.00 0 0 0 0 no
37 0.00 261 1.00 44 1.00 0 0 0 0 yes
37 0.00 16 1.00 0 0.00 0 0 0 0 yes
51 0.00 24 1.00 15 0.28 0 0 0 0 yes
51 1.00 21 0.00 121 0.00 0 0 0 0 yes
72 0.00 72 0.00 0 0.00 0 0 0 0 yes
107 0.48 15 1.00 282 0.00 0 0 0 0 no
114 0.00 240 1.00 25 0.00 0 0 0 0 yes
121 0.00 16 1.00 11 1.00 0 0 0 0 yes
121 0.00 0 0.00 10 1.00 0 0 0 1 yes
121 0.33 11 1.00 8 0.00 0 0 0 1 yes
198 0.87 198 0.00 1 0.00 0 0 0 0 no
205 0.00 296 0.00 20 0.00 0 0 0 0 yes
219 1.00 44 0.00 275 0.00 0 0 0 1 yes
226 0.21 5 0.27 30 0.45 0 0 0 0 yes
226 0.56 28 0.38 5 0.00 0 0 0 1 no
226 0.58 8 0.00 156 0.00 0 0 0 0 no
268 1.00 17 0.00 3 0.00 0 0 0 0 no
275 0.64 13 0.00 191 0.23 0 0 0 0 yes
282 1.00 26 0.41 296 0.00 0 0 0 1 no
13 0.00 9 0.00 11 0.00 1 0 0 0 no
58 0.00 275 0.99 6 1.00 1 0 0 0 yes
156 0.00 3 1.00 177 0.00 1 0 0 1 yes
282 0.57 163 0.00 5 0.00 1 0 0 0 no
1 0.00 20 1.00 226 0.00 2 0 0 0 no
15 0.00 163 1.00 254 0.00 2 0 0 0 no
156 0.00 5 0.00 261 1.00 2 0 0 0 no
6 0.00 19 1.00 11 0.00 0 -1 1 0 no
170 0.00 23 1.00 15 0.48 0 -1 1 0 no
2 1.00 142 0.00 247 1.00 0 -1 0 0 no
5 0.00 0 0.00 20 0.00 0 -1 0 0 no
8 0.00 13 0.00 170 0.00 0 -1 0 0 no
8 1.00 19 0.00 93 0.00 0 -1 0 0 no
14 0.00 24 0.93 128 0.00 0 -1 0 0 no
16 1.00 24 0.22 219 1.00 0 -1 0 0 no
25 1.00 107 0.33 19 0.00 0 -1 0 0 no
28 1.00 1 0.00 0 0.00 0 -1 0 1 no
18 1.00 27 1.00 17 0.00 1 -1 0 0 no
28 0.00 282 0.00 156 0.00 1 -1 0 0 no
107 0.00 135 1.00 25 1.00 1 -1 0 0 no
149 0.57 121 0.03 0 0.00 1 -1 0 0 no
289 0.00 10 0.00 226 0.00 1 -1 0 1 no
12 0.00 29 0.00 282 0.00 2 -1 0 0 no
19 1.00 5 1.00 114 1.00 2 -1 0 0 no
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | bool:
    """(feature, threshold, tree up to it, tree above it), or a leaf's answer."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            gini = sum(part.sum() * (1 - part.mean()) for part in (y[low].astype(float), y[~low].astype(float)))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, float(t)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def examples() -> tuple[np.ndarray, np.ndarray]:
    """The features of the labelled table and its answers."""
    rows = [line.split() for line in EXAMPLES.strip().splitlines()]
    return np.array([[float(v) for v in r[:-1]] for r in rows]), np.array([r[-1] == "yes" for r in rows])


def trained() -> tuple | bool:
    return grow(*examples())


def decide(tree: tuple | bool, features: tuple) -> bool:
    while not isinstance(tree, bool):
        f, t, low, high = tree
        tree = low if features[f] <= t else high
    return tree


def main_text(page: str | None, tree: tuple | bool) -> str:
    found = blocks(page)
    has_article = any(b.inside for b in found)
    density = [(b.words, b.linked / b.words) for b in found]
    kept: dict[int, Block] = {}
    asides: set[int] = set()
    for i, b in enumerate(found):
        before, after = density[i - 1] if i else (0, 0.0), density[i + 1] if i + 1 < len(found) else (0, 0.0)
        place = (1 if b.inside else -1) if has_article else 0
        if decide(tree, (*density[i], *before, *after, b.hint, place, b.heading, b.item)):
            if b.aside:
                asides.add(b.line)
            kept.setdefault(b.line, b) if b.aside else kept.__setitem__(b.line, b)
    out = []
    for line, b in kept.items():
        joined = "".join(t for t, aside in b.pieces if not aside or line in asides) if b.pieces else b.text
        out.append(" ".join(joined.split()))
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    tree = trained()

    def run(batch: pa.RecordBatch):
        texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_texts(picked, run, "page_id long, url string, text string, n_chars long", text="html")
