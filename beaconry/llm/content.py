"""Operator 13: main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events. Block boundaries cut the page into
lines, each with its text, the number of tags since the last line and the chain of
elements it lies in. A line's ratio is its characters outside links by its tags;
lines inside boilerplate (by element, role, or a word of class or id) have ratio 0.
The ratios are smoothed with a Gaussian, and lines at or above their standard
deviation are content; runs of such lines are clusters. The clusters vote, with
their characters, for the region: the article that holds at least half of them,
else such a main element, else the deepest element that holds most. All lines of
the region that aren't boilerplate are its text, short paragraphs and headings
included; outside an article lines of links alone are left out unless they are content.

Defined results: null, empty and text-free pages give an empty text; markup that
never closes is closed by the end of the page; a page without any tag is one line
of text; repeated rows are rows of their own; an empty table gives an empty table.
White space is what Unicode calls so, decoded references included. Only page_id,
url and html are read.
"""
from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import map_rows, table

#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.0
#: An element holds most of the content from this share on; an article or main element from ELEMENT_SHARE.
MOST = 0.8
ELEMENT_SHARE = 0.5

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read, and elements that are boilerplate as a whole.
SILENT = frozenset("head title script style template noscript svg math iframe object canvas audio video map".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog form button select textarea fieldset option datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Words of class and id that mark boilerplate.
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination header masthead topbar footer sidebar aside widget widgets "
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations "
    "teaser form search toolbar copyright disclaimer legal skip".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: An open element of the key is closed by the start of one of these.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["body"]), "title": frozenset(["body"]),
}


class Element:
    __slots__ = ("name", "parent", "number", "silent", "boiler", "marked", "wide")

    def __init__(self, name: str, parent: "Element | None", number: int, attributes: dict[str, str | None]):
        self.name, self.parent, self.number = name, parent, number
        style = (attributes.get("style") or "").replace(" ", "").lower()
        self.silent = name in SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        self.boiler = name in BOILERPLATE
        self.marked = (attributes.get("role") or "").lower() in ROLES
        if ("class" in attributes or "id" in attributes) and name not in ("html", "body", "main"):
            words = _WORD.findall(f"{attributes.get('class') or ''} {attributes.get('id') or ''}")
            self.marked = self.marked or any(w.lower() in MARKS for w in words)
        self.wide = False  # holds the page's heading or main element: what marks and forms say is not believed


class Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, innermost block element), and all
    elements, parents first. Inline elements are no elements here."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = Element("", None, 0, {})
        self.elements = [self.at]
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, Element]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.silent = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers of the source are not wanted

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.at))
                self.tags = 0
            self.parts, self.linked = [], 0

    def close_element(self) -> None:
        self.silent -= self.at.silent
        self.open[self.at.name] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.flush()
        self.links = 0
        upper = self.at
        while upper.name in CLOSED_BY:  # implied ends; other elements hold them up
            if tag in CLOSED_BY[upper.name]:
                while self.at is not upper:
                    self.close_element()
                self.close_element()
            upper = upper.parent
        if tag in VOID:
            return
        self.at = Element(tag, self.at, len(self.elements), dict(attrs))
        self.elements.append(self.at)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += self.at.silent
        if tag in ("h1", "main"):
            e = self.at.parent
            while e is not None and not e.wide:
                e.wide, e = True, e.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE:
            self.links -= tag == "a" and self.links > 0
            return
        self.flush()
        if self.open.get(tag):
            while self.at.name != tag:
                self.close_element()
            self.close_element()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # the base class fails on unknown ones

    def close(self) -> None:
        """Ends the page. A tag or comment that never ends runs to the end of the page and is no text;
        the base class would try again behind each of its characters."""
        if self.rawdata == "<" or not self.rawdata.startswith("<") and not self.cdata_elem:
            self.handle_data(unescape(self.rawdata))
        self.flush()


def boilerplate(elements: list[Element]) -> np.ndarray:
    """Whether a line right in each element is boilerplate. Only headings survive in the header of an article or main element."""
    bad = np.zeros((len(elements), 2), bool)  # other lines, headings
    shelter = np.zeros(len(elements), bool)
    for e in elements[1:]:
        up = e.parent.number
        shelter[e.number] = shelter[up] or e.name in ("article", "main")
        own = e.boiler and not (e.wide and e.name in ("form", "fieldset")) or e.marked and not e.wide
        bad[e.number] = bad[up] | own
        if e.name == "header":
            bad[e.number] = True, bad[up, 1] or not shelter[up]
    heading = np.array([e.name in HEADINGS for e in elements])
    return np.where(heading, bad[:, 1], bad[:, 0])


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean; at the ends over the lines that exist."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach:-reach]


def region_of(elements: list[Element], votes: np.ndarray) -> tuple[Element, bool]:
    """The element that the content's characters vote for, and whether its name says that it is one text."""
    votes = votes.copy()
    total = votes.sum()
    for e in reversed(elements[1:]):
        votes[e.parent.number] += votes[e.number]
    within = {name: np.zeros(len(elements), bool) for name in ("article", "main")}
    for name, held in within.items():
        best = None
        for e in elements[1:]:
            up = held[e.parent.number]
            held[e.number] = up or e.name == name
            if e.name == name and not up and votes[e.number] >= ELEMENT_SHARE * total and (best is None or votes[e.number] > votes[best.number]):
                best = e
        if best is not None:
            return best, True
    return max((e for e in elements if votes[e.number] >= MOST * total), key=lambda e: e.number), False


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines, elements = parser.lines, parser.elements
    if not lines:
        return ""
    where = np.array([element.number for *_, element in lines])
    boiler = boilerplate(elements)[where]
    size = np.array([len(text) for text, *_ in lines])
    linked = np.minimum(size, [n for _, _, n, _ in lines])
    tags = np.array([max(1, n) for _, n, _, _ in lines])
    level = smoothed(np.where(boiler, 0, (size - linked) / tags), sigma)
    content = ~boiler & (level > 0) & (level >= level.std())
    if not content.any():
        content = ~boiler
    if not content.any():
        return ""
    region, believed = region_of(elements, np.bincount(where[content], size[content], minlength=len(elements)))
    inside = np.zeros(len(elements), bool)
    for e in elements:
        inside[e.number] = e is region or e.parent is not None and inside[e.parent.number]
    kept = inside[where] & ~boiler
    if not believed:
        kept &= content | (linked <= size / 2)
        # the heading just before a region without one belongs to it
        top = np.array([element.name == "h1" for *_, element in lines]) & ~boiler
        before = np.flatnonzero(top[: int(kept.argmax())])
        if not (top & kept).any() and len(before):
            kept[before[-1]] = True
    return " ".join(lines[i][0] for i in np.flatnonzero(kept))


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def each(rows: dict) -> dict:
        texts = [main_text(html, sigma) for html in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, text string, n_chars long", each)


def op13_html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
