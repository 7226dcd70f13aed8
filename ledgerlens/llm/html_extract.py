"""HTML main text: standard-library parser events become lines, whose smoothed text-to-tag ratios choose the content regions.

``Reader`` follows the events of a page without building a tree. A line is what
stands between two block tags; it knows its characters, those inside links, its
tags, and where it stands. Lines under elements that are no main text by their
kind, role, name or being hidden (menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, comments of readers) stay in the sequence
with a ratio of zero, so that they separate regions, and give no text.

``chosen`` smooths the ratios (log scale) with a Gaussian window and takes the
lines above their standard deviation as seeds. Seeds say which regions hold the
content: the articles, else the main part, else named content blocks, if these
hold at least half of the seeds' text; else the blocks in which seeds stand.
A region then gives all its lines, short ones too.

Work is linear in a page's length, all within its row: no shuffle, no hot key.

Defined cases: null, empty and blank pages and pages without text have the text
``""``; tags that are cut off at the end, never closed or never opened are read
as browsers do; character references are decoded once; every run of white space
is one space; repeated rows and ids change nothing; other columns stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ledgerlens.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Never main text.
DROPPED = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input legend menu nav noframes noscript object search script select style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: First or last parts of names of elements that are no main text.
DROPPED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup promo promos promoted recommendations recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: These count as no main text only outside of the article, or if their name says that they are the page's.
PAGE_ONLY = frozenset(["header"])
OF_PAGE = frozenset("global page site top".split())
#: Names that begin so speak about the page, not about the element.
ABOUT = frozenset("has with no is show hide js".split())
CONTENT_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
#: Elements whose end closes what is open inside them, by the tag that starts: (closed tags, tags that shield them).
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",))}
SHIELDS_P = ("td", "th", "caption", "table", "button", "object")
KEEPS_P_OPEN = frozenset("body br caption head html tbody td tfoot th thead title tr".split())
CONTAINERS = frozenset("article blockquote body center details div dl figure main ol section table td th ul".split())
#: Weights of the Gaussian window (radius 2, sigma 1).
WINDOW = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
#: More of a line's characters in links than this make it a list of links.
LINKED = 2 / 3
RIGHTS = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
ARTICLE, MAIN, NAMED = range(3)


def _name_parts(name: str) -> list[str]:
    return [p.lower() for p in PARTS.findall(name)]


class Line:
    """Text between two block tags."""

    __slots__ = ("text", "linked", "tags", "dropped", "homes", "container")

    def __init__(self, text: str, linked: int, tags: int, dropped: bool, homes: tuple[int, ...], container: int):
        self.text, self.linked, self.tags, self.dropped, self.homes, self.container = text, linked, tags, dropped, homes, container


class Reader(HTMLParser):
    """Events of one page to ``lines``; ``kinds`` has the kind of each home (a region that may hold the article, not inside another of its kind)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[int] = []
        self._open: list[str] = []
        self._at: dict[str, list[int]] = defaultdict(list)  # places of open tags
        self._dropped_from: int | None = None
        self._homes: list[tuple[int, int]] = []
        self._containers: list[tuple[int, int]] = [(-1, 0)]
        self._n_containers = 1
        self._text: list[str] = []
        self._linked = self._tags = 0

    @classmethod
    def read(cls, html: str) -> Reader:
        """All of a page. A comment or tag that never ends is left out, as browsers do."""
        start = html.find("<!--", html.rfind("-->") + 1)
        if start >= 0 and "</script" not in html[start:].lower():
            html = html[:start]
        if cut := re.compile("<[a-zA-Z/!?]").search(html, html.rfind(">") + 1):
            html = html[: cut.start()]
        reader = cls()
        reader.feed(html)
        reader.close()
        reader._flush()
        return reader

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as <![if ...]> are skipped whatever their keyword."""
        return self.rawdata.find(">", i) + 1 or -1

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text or self._tags:
            self.lines.append(Line(text, self._linked, self._tags, self._dropped_from is not None, tuple(h for _, h in self._homes), self._containers[-1][1]))
        self._text, self._linked, self._tags = [], 0, 0

    def _nearest(self, tags: tuple[str, ...]) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=-1)

    def _pop_to(self, place: int) -> None:
        """Closes everything from this place on."""
        while len(self._open) > place:
            self._at[self._open.pop()].pop()
        if self._dropped_from is not None and self._dropped_from >= place:
            self._dropped_from = None
        while self._homes and self._homes[-1][0] >= place:
            self._homes.pop()
        while self._containers[-1][0] >= place:
            self._containers.pop()

    def _no_content(self, tag: str, attrs: dict[str, str | None], names: list[list[str]]) -> bool:
        if tag in ("html", "body"):
            return False
        if tag in DROPPED or (attrs.get("role") or "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or ""):
            return True
        ends = {p for parts in names if parts and parts[0] not in ABOUT for p in (parts[0], parts[-1])}
        if ends & DROPPED_NAMES:
            return True
        return (not self._homes or bool(ends & OF_PAGE)) and (tag in PAGE_ONLY or bool(ends & PAGE_ONLY))

    def _kind(self, tag: str, attrs: dict[str, str | None], names: list[list[str]]) -> int | None:
        if tag == "article" or (attrs.get("itemprop") or "").lower() == "articlebody" or (attrs.get("role") or "").lower() == "article":
            return ARTICLE
        if tag == "main" or (attrs.get("role") or "").lower() == "main":
            return MAIN
        return NAMED if tag in CONTAINERS and any(p in CONTENT_NAMES for parts in names for p in parts if parts[0] not in ABOUT) and tag != "body" else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag not in KEEPS_P_OPEN and self._at["p"] and self._at["p"][-1] > self._nearest(SHIELDS_P):
                self._pop_to(self._at["p"][-1])
            if tag in CLOSES:
                closed, shields = CLOSES[tag]
                if (place := self._nearest(closed)) > self._nearest(shields):
                    self._pop_to(place)
            if self._at["head"] and tag != "title":  # a head that was not closed ends with the first block
                self._pop_to(self._at["head"][0])
        self._tags += 1
        if tag in VOID:
            return
        place, found = len(self._open), dict(attrs)
        self._open.append(tag)
        self._at[tag].append(place)
        names = [_name_parts(n) for n in f"{found.get('class') or ''} {found.get('id') or ''}".split()] if "class" in found or "id" in found else []
        if self._dropped_from is None:
            if self._no_content(tag, found, names):
                if tag not in BLOCKS and self._text:  # an inline element within a line: only its own text goes
                    self._tags += 1
                self._dropped_from = place
            elif (kind := self._kind(tag, found, names)) is not None and all(self.kinds[h] != kind for _, h in self._homes):
                self._homes.append((place, len(self.kinds)))
                self.kinds.append(kind)
        if tag in CONTAINERS:
            self._containers.append((place, self._n_containers))
            self._n_containers += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML but for foreign elements
        if tag in ("svg", "iframe", "canvas") and self._at[tag]:
            self._pop_to(self._at[tag][-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._tags += 1
        if self._at[tag]:
            self._pop_to(self._at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self._dropped_from is None:
            self._text.append(data)
            if self._at["a"]:
                self._linked += len(data)


def smoothed(lines: list[Line]) -> np.ndarray:
    """Text-to-tag ratios of lines on a log scale, smoothed by the window; zero for what is no main text."""
    ratios = np.array([0.0 if x.dropped or x.linked > LINKED * len(x.text) else np.log2(1 + len(x.text) / max(1, x.tags)) for x in lines])
    if not len(ratios):
        return ratios
    return np.convolve(ratios, WINDOW, mode="full")[2 : 2 + len(ratios)] / np.convolve(np.ones(len(ratios)), WINDOW, mode="full")[2 : 2 + len(ratios)]


def chosen(lines: list[Line], kinds: list[int]) -> list[Line]:
    """The lines of the content regions, in page order."""
    ratios = smoothed(lines)
    seeds = [x for x, r in zip(lines, ratios, strict=True) if x.text and not x.dropped and r >= ratios.std() and x.linked <= LINKED * len(x.text)]
    mass = sum(len(x.text) for x in seeds)
    for kind in (ARTICLE, MAIN, NAMED):
        held = [x for x in seeds if any(kinds[h] == kind for h in x.homes)]
        if held and 2 * sum(len(x.text) for x in held) >= mass:
            homes = {next(h for h in x.homes if kinds[h] == kind) for x in held}
            return [x for x in lines if x.text and not x.dropped and homes.intersection(x.homes)]
    containers = {x.container for x in seeds}
    return [x for x in lines if x.text and not x.dropped and x.container in containers and x.linked <= LINKED * len(x.text) and not RIGHTS.match(x.text)]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    reader = Reader.read(html or "")
    return " ".join(x.text for x in chosen(reader.lines, reader.kinds))


@F.pandas_udf(StructType().add("text", StringType()).add("n_chars", LongType()))
def _extracted(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for html in pages:
        text = [main_text(h) for h in html]
        yield pd.DataFrame({"text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of columns of these names."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (text, n_chars)]
    made = pages.withColumn("__main", _extracted(F.col(f"`{html}`").cast("string")))
    return made.select(*kept, F.col("__main.text").alias(text), F.col("__main.n_chars").alias(n_chars))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


#: The tables' pages keep their main text in one article of headings and paragraphs, with references of three kinds.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '<[^<>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM c)
SELECT page_id, url, t AS text, CAST(length(t) AS BIGINT) AS n_chars FROM d
"""
