"""Main text of web pages: html.parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The parser's events give a page's blocks, which are its lines here: a line has text, a count of tags, a count of characters
inside links, and the section that it stands in: its article or main element, or else the element about its paragraphs. Lines
below elements that name navigation, adverts, forms or comments are outside, and lines made mostly of links are no text.

Of the others the ratio of text to tags is smoothed over the page. Lines whose ratio reaches the threshold, smoothed and by
itself, are the cores of clusters, and a cluster is a core's section: its paragraphs, headings and list items, however short, since they are text by
their element, and its other lines (text right inside a div and the like) where their own ratio reaches the threshold too. A
heading that ends where a cluster begins belongs to it. Sections without a core are not content. Article and main elements come
first: where one holds a line, the ratios, the threshold and the clusters are those of such lines alone.

Names count with care. A class names a part outside the article only if all its words are known as such names or as plain
companions of them (`ad-slot`, not `ad-free` or `has-sidebar`). An element that holds the main element, or one of a loose kind that
holds an article or the page's first heading, is about the page, not outside. If nothing is left, what holds most of the page's
text is not outside either.

Defined results: null or empty html has empty text; broken markup never fails (the parser recovers, and an element that should
hide its text but never ends hides nothing); repeated rows get equal results; pages are read whole, however long; a page
whose lines are all outside or links has empty text, but for the last rule above."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import objects

#: Elements whose text is no text of the page.
SKIPPED = set("script style title noscript template iframe object embed svg math canvas audio video head select button textarea".split())
#: Those that hold no blocks, so a block after one that was not closed ends it.
LIGHT = set("head title button select textarea".split())
#: Elements that hold no content of the article, and those of them that some pages put about all they have.
OUTSIDE = set("nav header footer aside form menu dialog fieldset".split())
LOOSE = set("form dialog fieldset".split())
#: Elements that end a block.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose text is text by their element, and those that stand between them and their section.
PROSE = HEADINGS | set("p li dd dt blockquote pre td th caption figcaption summary address".split())
INNER = PROSE | set("ul ol dl dir table tbody thead tfoot tr hgroup center figure details".split())
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name a part outside the article.
_KINDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie "
    "cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promotion related replies "
    "responses search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that stand beside them in such names.
_PLAIN = set(
    "area bar block body bottom box button buttons container content form global group icons inner item items left link links list main media page panel "
    "post posts primary right secondary section site slot stories text top unit wrap wrapper".split()
)


def named_outside(names: str) -> bool:
    """Whether one of the names is made of known words, one of which is a kind of such a part."""
    for token in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", token) if x and not x.isdigit()]
        if parts and _KINDS & set(parts) and set(parts) <= _KINDS | _PLAIN:
            return True
    return False


#: Elements that are closed by the start of another of their kind.
_AUTO = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_WHITE = re.compile(r"\s+")


class Line:
    """A block of text."""

    def __init__(self, text: str, tags: int, linked: int, below: tuple[int, ...], section: int, article: bool, prose: bool, heading: bool):
        self.text, self.tags, self.linked, self.below = text, tags, linked, below
        self.section, self.article, self.prose, self.heading = section, article, prose, heading


class Lines(HTMLParser):
    """Collects the lines of a page, and of each element that may be outside: whether it is loose, what it holds, and how much text."""

    def __init__(self, never_end: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.never_end = never_end
        self.lines: list[Line] = []
        self.open: list[tuple[str, tuple[int, ...], int, bool]] = []  # name, outside elements about it, section, in an article
        self.outside: list[dict] = []
        self.skipped = self.links = self.sections = self.headings = 0
        self.skip_name = ""
        self._fresh()

    def _fresh(self) -> None:
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if text := _WHITE.sub(" ", "".join(self.parts)).strip():
            name, below, section, article = self.open[-1] if self.open else ("", (), 0, False)
            self.lines.append(Line(text, self.tags, self.linked, below, section, article, name in PROSE, name in HEADINGS))
            for k in below:
                self.outside[k]["chars"] += len(text)
            self._fresh()
        else:
            self.parts = []

    def handle_starttag(self, tag, attrs) -> None:
        if self.skipped and self.skip_name in LIGHT and (tag in BLOCKS or tag == "body"):  # its end tag is missing
            self.skipped = 0
        if self.skipped:
            self.skipped += tag == self.skip_name
            return
        if tag in SKIPPED and tag not in self.never_end:
            if tag not in VOID:
                self.skipped, self.skip_name = 1, tag
            return
        if tag in BLOCKS:
            self.flush()
            closes = _AUTO.get(tag, {"p"})
            if self.open and self.open[-1][0] in closes:
                self.open.pop()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag not in BLOCKS:
            self.links += tag == "a"
            return
        _, below, section, article = self.open[-1] if self.open else ("", (), 0, False)
        for k in below:
            self.outside[k]["main"] |= tag == "main"
            self.outside[k]["article"] |= tag == "article" or tag == "h1" and not self.headings
        self.headings += tag == "h1"
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        named = bool(names) and tag not in ("body", "html", "main") and named_outside(names)
        header_inside = tag == "header" and article and not below
        if named or tag in OUTSIDE and not header_inside:
            self.outside.append({"loose": tag in LOOSE or tag not in OUTSIDE, "main": False, "article": False, "chars": 0})
            below = (*below, len(self.outside) - 1)
        if tag in ("article", "main"):
            article = True
            self.sections += 1
            section = self.sections
        elif not article and tag not in INNER:
            self.sections += 1
            section = self.sections
        self.open.append((tag, below, section, article))

    def handle_endtag(self, tag) -> None:
        if self.skipped:
            self.skipped -= tag == self.skip_name
            return
        if tag not in BLOCKS:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data) -> None:
        if self.skipped:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def unknown_decl(self, data) -> None:
        """Marked sections are markup."""


def read(html: str) -> Lines:
    """The page's lines. An element that hides its text but does not end is taken for one that hides none, and the page is read again."""
    never_end: frozenset[str] = frozenset()
    while True:
        page = Lines(never_end)
        page.feed(html)
        page.close()
        page.flush()
        if not page.skipped or page.skip_name in ("script", "style") or page.skip_name in never_end:
            return page
        never_end |= {page.skip_name}


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """values under a Gaussian kernel of radius 3 sigma, renormalised at the ends."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[radius : radius + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[radius : radius + len(values)]


def clusters(lines: list[Line], sigma: float = 1.0, share: float = 0.5) -> np.ndarray:
    """Which of the lines are content: those of the sections that hold a core.

    The threshold is share times the standard deviation or the mean of the smoothed ratios, the greater one, at least 1."""
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    smooth = smoothed(ratio, sigma)
    threshold = max(1.0, share * max(smooth.std(), smooth.mean()))
    cored = {x.section for x, v, own in zip(lines, smooth, ratio, strict=True) if min(v, own) >= threshold}
    keep = np.array([x.section in cored and (x.prose or bool(v >= threshold)) for x, v in zip(lines, ratio, strict=True)])
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= lines[i].heading and keep[i + 1]
    return keep


def content(html: str | None, sigma: float = 1.0, share: float = 0.5) -> list[str]:
    """The blocks of the page's main text, in page order."""
    if not html:
        return []
    page = read(html)
    lines = [x for x in page.lines if 2 * x.linked <= len(x.text)]
    about = {k for k, o in enumerate(page.outside) if o["main"] or o["loose"] and o["article"]}
    inside = [x for x in lines if about.issuperset(x.below)]
    if not inside and lines:
        total = sum(len(x.text) for x in page.lines)
        about |= {k for k, o in enumerate(page.outside) if 2 * o["chars"] > total}
        inside = [x for x in lines if about.issuperset(x.below)]
    if any(x.article for x in inside):
        inside = [x for x in inside if x.article]
    return [x.text for x, k in zip(inside, clusters(inside, sigma, share), strict=True) if k] if inside else []


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = ["\n\n".join(content(h)) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array, "url": objects(batch["url"]), "text": objects(text), "n_chars": [len(x) for x in text]})

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, SCHEMA)
