"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each
block. A line's ratio is its characters outside of links for each tag; ratios
are smoothed along the page with a Gaussian, and lines above the threshold (the
smaller of two clusters' midpoint and the mean) or of running text by
themselves are content. The region is all article and main elements if they
hold half of the content, or else the smallest container that holds every
content line and main heading; lists, tables and quotations are parts of a text
and no region.

Inside the region ratios decide again: a container without any content line
whose characters are for the most part those of links goes. Containers known
by tag or class as something else (menus, forms, adverts, comments ...) go too.
Short lines beside content stay.

Containers are runs of lines, so all of this takes time in proportion to the
page, however deep its elements are.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import spread

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    # without text of the page, but allowed inside a line
    "script style noscript template button select textarea iframe object svg canvas audio video".split()
)
SKIPPED = set("script style noscript template nav footer aside form button select textarea fieldset dialog iframe object svg canvas audio video menu head title".split())
#: Words in class, id or role that mark a container as something else than the article.
ASIDE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead comment comments reply replies discussion disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer complementary contentinfo search".split()
)
#: Of these, words that a section of a text may be about, with what then follows.
TOPICS = set("related search discussion notice notices alert social recommended".split())
SUBJECTS = set("work works research literature methods results studies science theory problems history questions".split())
#: A class that begins so tells of something elsewhere on the page.
ELSEWHERE = set("has with without no not is".split())
MAIN = ("article", "main")
#: Blocks inside of a text, which do not bound it.
PARTS = set("ul ol dl li dt dd table caption colgroup thead tbody tfoot tr td th blockquote pre figure figcaption details summary address hgroup".split())
#: Blocks that hold a line and bound nothing.
PLAIN = set("p li h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of their kind.
REPEATED = set("li dt dd tr td th option".split())
#: Characters for each tag from which on a line is running text.
RUNNING = 40

#: Tags whose attributes the parser may fail to read before they are skipped unread.
MOST_BROKEN = 100

_WORD = re.compile(r"[a-z]+")
_TAG = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_OPENS = re.compile(r"<[!?]")
_HIDDEN = re.compile(r"display\s*:\s*none")


class _Lines(HTMLParser):
    """Lines of a page: text, tags and link characters in it; containers as runs of lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.tags_in: list[int] = []
        self.linked: list[int] = []
        self.titles: list[bool] = []  # of lines: inside h1
        self.kind: list[str] = []  # of containers: tag, first line, line after the last
        self.begin: list[int] = []
        self.end: list[int] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, container number or -1, skipped
        self.at: dict[str, list[int]] = {}  # places of open elements by tag
        self.blocks: list[int] = []  # places of those that are not inline
        self.boxes: list[int] = []  # places of containers
        self.parts: list[str] = []
        self.tags = self.skip = self.link_chars = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(text)
            self.tags_in.append(self.tags)
            self.linked.append(self.link_chars)
            self.titles.append(bool(self.at.get("h1")))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def _push(self, tag: str, skipped: bool) -> None:
        box = tag not in INLINE and tag not in PLAIN
        place = len(self.open)
        self.open.append((tag, len(self.kind) if box else -1, skipped))
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        if box:
            self.boxes.append(place)
            self.kind.append(tag)
            self.begin.append(len(self.lines))
            self.end.append(-1)
        self.skip += skipped

    def _pop(self) -> None:
        tag, box, skipped = self.open[-1]
        if tag not in INLINE:
            self._end_line()
            self.blocks.pop()
        self.open.pop()
        self.at[tag].pop()
        if box >= 0:
            self.boxes.pop()
            self.end[box] = len(self.lines)
        self.skip -= skipped

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _aside(self, tag: str, attrs) -> bool:
        """Whether an element is something else than text. Words in class, id or
        role count for containers only: a marked span or heading is part of its text."""
        if tag in ("html", "body", "main"):
            return False
        if tag in SKIPPED or (tag == "header" and not any(self.at.get(x) for x in MAIN)):
            return True
        marks = tag not in INLINE and tag not in PLAIN and not (tag in PARTS and any(self.at.get(x) for x in MAIN))
        for name, value in attrs:
            if marks and name in ("class", "id", "role") and value:
                for words in map(_WORD.findall, value.lower().split()):
                    if words and words[0] not in ELSEWHERE and not ASIDE.isdisjoint(words):
                        # "related work" and the like: a section of the text with a name of its own
                        if tag == "section" and any(self.at.get(x) for x in MAIN) and ASIDE.intersection(words) <= TOPICS and words[-1] in SUBJECTS:
                            continue
                        return True
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value.lower())):
                return True
        return False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.tags += 1
            return
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            self.tags += 1
            return
        if tag not in INLINE:
            # a block ends an open paragraph or item, with what is open inside
            if self.blocks:
                top = self.open[self.blocks[-1]][0]
                if top == "p" or (top == tag and tag in REPEATED):
                    self._pop_to(self.blocks[-1])
            self._end_line()
        self._push(tag, self._aside(tag, attrs))
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        place = self.at[tag][-1] if self.at.get(tag) else -1
        # an inline element ends inside its block, a paragraph inside its container
        within = (self.blocks[-1:] if tag in INLINE else self.boxes[-1:] if tag == "p" else []) or [-1]
        if place > within[0]:
            self._pop_to(place)
            self.tags += 1
        elif tag in ("p", "br"):
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.at.get("a"):
                self.link_chars += len(data.strip())

    # Markup that never ends, or that the parser has no rule for: each of these takes the text up to the
    # next mark that ends it, so that nothing is looked at twice. feed() has cut off what has no ">" behind it.

    def feed(self, data: str) -> None:
        """The whole page at once."""
        cut = data.rfind(">") + 1
        tail = data[cut:]
        unfinished = _OPENS.search(tail)
        self.broken, self.last = 0, {}
        super().feed(data[:cut] + (tail[: unfinished.start()] if unfinished else tail).replace("<", "&lt;"))

    def _ahead(self, mark: str, i: int) -> bool:
        """Whether mark comes at i or later."""
        key = (mark, len(self.rawdata))
        if key not in self.last:
            self.last[key] = self.rawdata.rfind(mark)
        return self.last[key] >= i

    def _next(self, i: int) -> int:
        at = self.rawdata.find(">", i)
        return len(self.rawdata) if at < 0 else at + 1

    def parse_comment(self, i: int, report: int = True) -> int:
        return super().parse_comment(i, report) if self._ahead("-->", i + 4) else self._next(i)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            if self.rawdata[i + 3 : i + 9].upper() == "CDATA[" and self._ahead("]]>", i):
                return self.rawdata.index("]]>", i) + 3
            return self._next(i)
        found = super().parse_html_declaration(i)
        return self._next(i) if found < 0 else found

    def parse_starttag(self, i: int) -> int:
        found = super().parse_starttag(i) if self.broken < MOST_BROKEN else -1
        if found < 0:
            self.broken += 1
            self.handle_starttag(_TAG.match(self.rawdata, i + 1).group().lower(), [])
            return self._next(i)
        return found

    def parse_endtag(self, i: int) -> int:
        found = super().parse_endtag(i)
        return self._next(i) if found < 0 else found

    def close(self) -> None:
        super().close()
        self._pop_to(0)
        self._end_line()


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """values with a Gaussian over neighbours; weights add up to 1 at the ends too."""
    reach = max(1, round(3 * sigma))
    kernel = np.array([exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)])
    whole = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / whole


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Of smoothed ratios, those of the upper of two clusters (by iterated midpoints), or above the mean if that is less."""
    cut = ratios.mean()
    for _ in range(20):
        low, high = ratios[ratios <= cut], ratios[ratios > cut]
        if not len(low) or not len(high) or cut == (new := (low.mean() + high.mean()) / 2):
            break
        cut = new
    return ratios >= min(cut, ratios.mean())


def main_text(html: str | None) -> str:
    """Text of the main region, a line for each block; empty if there is none."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    n = len(page.lines)
    if not n:
        return ""
    sizes = np.array([len(t) for t in page.lines], dtype=float)
    linked = np.minimum(np.array(page.linked, dtype=float), sizes)
    own = (sizes - linked) / np.maximum(1, np.array(page.tags_in))
    content = content_lines(smoothed(own)) & (2 * linked < sizes) | (own >= RUNNING) | np.array(page.titles)
    begin, end = np.array(page.begin, dtype=np.int64), np.array(page.end, dtype=np.int64)

    def covered(boxes: np.ndarray) -> np.ndarray:
        """Lines of any of the containers."""
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, begin[boxes], 1)
        np.add.at(edge, end[boxes], -1)
        return np.cumsum(edge[:-1]) > 0

    before = lambda values: np.append(0, np.cumsum(values))
    marked = np.array([k in MAIN for k in page.kind], dtype=bool)
    inside = covered(marked) if len(marked) else np.zeros(n, dtype=bool)
    if 2 * sizes[content & inside].sum() >= sizes[content].sum() and (content & inside).any():
        region = inside
    else:
        region = np.ones(n, dtype=bool)
        content |= inside
        bounds = np.array([k not in PARTS for k in page.kind], dtype=bool)
        if content.any() and bounds.any():
            first, last = np.flatnonzero(content)[[0, -1]]
            holds = np.flatnonzero(bounds & (begin <= first) & (end > last))
            if len(holds):  # the last one to open is the smallest
                region = covered(holds[-1:])
    # containers of links: nothing in them is content, and links are most of their text
    if len(begin):
        some, chars, links = before(content), before(sizes), before(linked)
        of_links = (end - begin > 1) & (some[end] == some[begin]) & (2 * (links[end] - links[begin]) > chars[end] - chars[begin])
        rest = region & ~covered(of_links)
        if (rest & content).any():
            region = rest
    return "\n".join(t for t, good in zip(page.lines, region) if good)


def _extract(it):
    for batch in it:
        html = batch.column("html")
        for a in range(0, batch.num_rows, 256):
            texts = [main_text(x.as_py()) for x in html.slice(a, 256)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, 256), batch.column("url").slice(a, 256), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars (code points) for each row of pages.

    Null and empty pages, and those without text outside of menus and the like,
    have the text "". A page without markup is its own text. Unclosed and
    unopened tags are borne; a tag, comment or declaration that never ends ends
    at the next ">", or is text (a tag) or nothing where there is none. Ids and addresses may be null or repeated. Other
    columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return spread(rows).mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
