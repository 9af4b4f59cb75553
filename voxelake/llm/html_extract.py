"""Main-text extraction from HTML by text-to-tag ratios.

A streaming pass of the standard library's parser turns a page into lines: a block
element's text, with the tags met on the way and the element it stands in. Every
line has a text-to-tag ratio; the ratios are smoothed by a Gaussian along the page,
and a threshold (half their standard deviation, at most what plain text has) clusters
lines into content and the rest; lines that only their neighbours lift over it don't
count. The clusters decide the region: the innermost block that holds every content
line, and of the blocks that do, an article or main element if there is one. All lines
of the region belong to the text, short ones too, unless an element sets them apart
(navigation, notices, forms, comments, adverts); headings right in front of it go
with it.

Elements set apart by what they are (``nav``, a role, hidden ones) are never content.
Class and id names set apart containers only, never a heading, a paragraph or an
item, and only names made of nothing but such words and words of layout
("cookie-banner" does, "search-methods" does not); if what they name holds almost all
of the page's text, the names are not believed.

Defined results: null and empty html give an empty text; a page without content
lines gives an empty text; unclosed and stray tags are tolerated at any depth, in
time and memory by the page's length; a page of any length is parsed whole, in
pieces; repeated rows are each extracted; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import slices

#: Elements that start a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template head svg math iframe object embed canvas audio video map select textarea button datalist title".split())
#: Elements that never hold a page's article.
APART = frozenset("nav aside footer form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which one ends the other in the same list, and the lists.
LIKE = {t: (t,) for t in ("li", "option", "tr")} | dict.fromkeys(("dd", "dt"), ("dd", "dt")) | dict.fromkeys(("td", "th"), ("td", "th"))
LISTS = ("ul", "ol", "dl", "select", "table", "tr")
#: End tags that close whatever is open inside their element.
THROUGH = frozenset("html body article main section div table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of an element's class or id that mark it as something other than the article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus
    dropdown feedback footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination
    popup popular promo promoted promotion reactions recommended related replies respond reviews search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription tags teaser toolbar topbar widget widgets""".split()
)
#: Words of layout, which say nothing about what an element holds.
LAYOUT = frozenset(
    """area articles bar block bottom box boxes button buttons card cards col column container content fixed form frame global group holder icons inner item
    items js layer left line link links list main media module outer page panel policy post posts primary right root row section secondary site slot space
    sticky stories text top unit wrap wrapper""".split()
)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that can be the region of the content.
HOLDERS = BLOCKS - HEADINGS - {"p", "li", "td", "th"}
#: What class and id names can set apart.
NAMED = HOLDERS - {"html", "body", "article", "main", "blockquote", "pre", "figure", "figcaption"} | {"span"}
#: Characters to a tag that make a line text, whatever the page's other lines are.
PLAIN = 40.0
#: The share of a page's text that no name sets apart.
ALMOST_ALL = 0.95
ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


def apart(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether an element is apart from the article by what it is."""
    if tag in APART or tag == "header" and not inside_article:
        return True
    for name, value in attrs:
        if name in ("hidden", "aria-hidden") and value != "false" and (name == "hidden" or value == "true"):
            return True
        if value and (name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def named_apart(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether a container's class or id names it as something else."""
    if tag in NAMED:
        for name, value in attrs:
            if value and name in ("class", "id"):
                for token in value.split():
                    words = set(_WORDS.findall(_CAMEL.sub(" ", token).lower()))
                    if inside_article:  # an article's own header holds its headline
                        words.discard("header")
                    if words - LAYOUT and words <= MARKS | LAYOUT:
                        return True
    return False


class Element(NamedTuple):
    """An open element: its tag and number, and what it and those around it are."""

    tag: str
    number: int
    hidden: bool = False
    apart: bool = False
    named: bool = False
    inside: bool = False  # of an article or main element


class Line(NamedTuple):
    text: str
    tags: int
    element: int
    apart: bool
    named: bool


class Lines(HTMLParser):
    """Parser events to lines. Elements are numbered as they open: what is in element n has numbers n to ends[n] - 1."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", 0)]
        self.kinds, self.parents, self.ends = [""], [0], [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        self.blocks: list[int] = []  # where blocks are open
        self.held: list[str] = []
        self.tags = 0
        self.lines: list[Line] = []

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            e = self.open[-1]
            self.lines.append(Line(text, self.tags, e.number, e.apart, e.named))
            self.tags = 0
        self.held.clear()

    def close_to(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self.cut()
        while len(self.open) > at:
            e = self.open.pop()
            self.ends[e.number] = len(self.kinds)
            self.at[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these tags is, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.held.append("\n")
            return
        if tag in BLOCKS:
            self.cut()
            if tag in ENDS_P and self.blocks and self.open[self.blocks[-1]].tag == "p":
                self.close_to(self.blocks[-1])  # an open paragraph ends where a block starts
            if like := LIKE.get(tag):
                self.end_like(like)
        elif tag in ("img", "input"):
            self.held.append(" ")
        if tag in VOID:
            return
        e = self.open[-1]
        inside = e.inside or e.tag in ("article", "main")
        self.at[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(Element(tag, len(self.kinds), e.hidden or tag in HIDDEN, e.apart or apart(tag, attrs, inside), e.named or named_apart(tag, attrs, inside), inside))
        self.kinds.append(tag)
        self.parents.append(e.number)
        self.ends.append(0)

    def end_like(self, tags: tuple[str, ...]) -> None:
        at = self.last(*tags)
        if at > self.last(*(t for t in LISTS if t not in tags)):
            self.close_to(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.last(tag)
        if not at and tag in ("br", "p"):
            self.held.append("\n")
        # a stray end tag closes nothing around its container
        if at and (tag in THROUGH or at > self.last("article", "main", "body", "table")):
            self.close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].hidden:
            self.held.append(data)

    def read(self, html: str) -> None:
        for i in range(0, len(html), 1 << 16):
            self.feed(html[i : i + (1 << 16)])
        self.close()
        self.cut()
        self.close_to(1)
        self.ends[0] = len(self.kinds)

    def around(self, lines: list[Line]) -> list[int]:
        """The elements that hold all these lines, outermost first."""
        n, last = min(x.element for x in lines), max(x.element for x in lines)
        out = []
        while True:
            if self.ends[n] > last:
                out.append(n)
            if not n:
                return out[::-1]
            n = self.parents[n]


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines, normalised at the ends."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (np.convolve(x, k)[r : r + len(x)]) / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def clustered(lines: list[Line], able: list[bool], sigma: float) -> list[int]:
    """Numbers of the lines whose smoothed ratio of text to tags is over the threshold, of those that are ``able``."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    even = smooth(ratio, sigma)
    own = np.flatnonzero(able)
    limit = min(PLAIN, 0.5 * even[own].std())
    found = own[even[own] >= limit]
    # smoothing lifts the lines beside a cluster too: they don't count, unless nothing else does
    return found[ratio[found] >= limit].tolist() or found.tolist() or own.tolist()


def content(page: Lines, sigma: float = 1.0) -> list[str]:
    """The lines of the article, in page order."""
    lines, kinds = page.lines, page.kinds
    able = [not x.apart for x in lines]
    if not any(able):
        return []
    sizes = [len(x.text) * a for a, x in zip(able, lines, strict=True)]
    if sum(n for n, x in zip(sizes, lines, strict=True) if x.named) <= ALMOST_ALL * sum(sizes):
        able = [a and not x.named for a, x in zip(able, lines, strict=True)]
    found = clustered(lines, able, sigma)
    ours = [x for a, x in zip(able, lines, strict=True) if a]
    around = page.around([lines[i] for i in found])
    # all of these hold the whole content: the page's own word for its article decides, else the innermost block
    article = [n for n in around if kinds[n] in ("article", "main")]
    region = (article or [n for n in around if n == 0 or kinds[n] in HOLDERS])[-1]
    held = [region <= x.element < page.ends[region] for x in ours]
    first = title = held.index(True)
    if not heads(ours[first], page):  # the headline may stand in front of the block
        while title and heads(ours[title - 1], page):
            title -= 1
    return [x.text for n, (x, h) in enumerate(zip(ours, held, strict=True)) if h or title <= n < first]


def heads(line: Line, page: Lines) -> bool:
    """Whether a line stands in a heading, or in an inline element of one."""
    n = line.element
    while n and page.kinds[n] not in BLOCKS:
        n = page.parents[n]
    return page.kinds[n] in HEADINGS


def main_text(html: str | None) -> str:
    page = Lines()
    page.read(html or "")
    return "\n".join(content(page))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
