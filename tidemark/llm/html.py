"""Main text of web pages from text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block, with the
number of characters and of tags in it; a line break inside a block is white space. Hidden
elements and lines inside navigation, headers, footers, asides, forms, scripts and styles are
left out, and those in containers marked by class, id or role as adverts, notices, reader
comments and the like, unless the main text stands in such a one. The ratio of characters to
tags, link text counting against a line, is smoothed by a Gaussian over neighbouring lines and
clustered in two by a threshold. Lines of the high cluster and short gaps between them, but
for lines that are mostly links, are the text. Article and main elements are a hint on top:
one that holds a line of the high cluster also gives its other lines, but for containers that
are mostly links and mostly of the low cluster.

Every page is read in its own row; nothing is shuffled. Time is linear in the page.

* Null or empty html, or a page without content: empty text. Repeated rows stand one by one.
* Unclosed and stray tags are tolerated; an unfinished comment or tag at the end is dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named

#: Elements whose start and end break a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
DROPPED = frozenset(
    "nav footer aside form script style noscript template head title button select textarea "
    "iframe object svg canvas dialog menu".split()
)
#: Styles of elements that are not shown.
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are followed to know what a line stands in.
CONTAINERS = DROPPED | frozenset(
    "article blockquote body div dl figure header html main ol section table td ul p li".split()
) - frozenset({"p", "li"})
#: Classes, ids and roles that mark what is not content, up to the words of NEUTRAL in them.
MARKED = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|"
    r"overlay|newsletter|subscri\w+|signup|login|comments?|disqus|replies|respond|sidebar|"
    r"aside|widget|related|recommend\w*|breadcrumbs?|pagination|pager|share|sharing|social|menu|nav|navbar|"
    r"navigation|topbar|toolbar|masthead|footer|copyright|skip|alert|contentinfo|complementary|search"
)
#: The same for an article element.
REPLY = re.compile(r"comments?|repl(?:y|ies)")
NEUTRAL = frozenset(
    "area bar block body bottom box container form global icons inner item items left link links list main message outer "
    "policy right section site slot text top unit wrap wrapper".split()
)


def marked(value: str, words: re.Pattern = MARKED) -> bool:
    """Whether one of the names says so with all its words: ``site-footer`` does, ``has-sidebar`` does not."""
    for name in value.lower().split():
        if name in ("side", "side-bar") and words is MARKED:
            return True
        telling = [w for w in re.split(r"[^a-z]+", name) if w and w not in NEUTRAL]
        if telling and all(words.fullmatch(w) for w in telling):
            return True
    return False


@dataclass
class Line:
    text: str
    tags: int
    container: int
    article: int
    linked: int
    marks: tuple[int, ...]


@dataclass
class _Open:
    tag: str
    number: int
    dropped: bool
    article: int
    marks: tuple[int, ...] = ()


@dataclass
class Reader(HTMLParser):
    """Collects lines from parser events."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", 0, False, 0)]
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0
        self.linked = 0
        self.containers = 0
        self.mains: set[int] = set()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        top = self.stack[-1]
        if text and not top.dropped:
            self.lines.append(Line(text, max(1, self.tags), top.number, top.article, self.linked, top.marks))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        unseen = tag not in VOID and any(k == "hidden" or (k == "style" and v and UNSEEN.search(v)) for k, v in attrs)
        top = self.stack[-1]
        if tag in BLOCKS and top.tag == "p" and tag not in CONTAINERS:
            self.stack.pop()  # a hidden paragraph that nothing closed
        if (unseen or (top.dropped and tag == top.tag)) and tag not in CONTAINERS:
            top = self.stack[-1]
            self.stack.append(_Open(tag, top.number, top.dropped or unseen, top.article, top.marks))
        elif tag in CONTAINERS and tag not in VOID:
            self.links = 0
            top = self.stack[-1]
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            dropped = top.dropped or tag in DROPPED or (tag == "header" and not top.article)
            doubted = tag not in ("html", "body", "main") and marked(names, REPLY if tag == "article" else MARKED)
            dropped = dropped or unseen
            self.containers += 1
            marks = (*top.marks, self.containers) if doubted else top.marks
            article = top.article or (self.containers if tag in ("article", "main") and not doubted else 0)
            if tag == "main":
                self.mains.update(marks)
            self.stack.append(_Open(tag, self.containers, dropped, article, marks))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        self.tags += 1
        if tag == "a" or tag in CONTAINERS:
            self.links = 0
        if tag in CONTAINERS or self.stack[-1].tag == tag:
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag == tag:
                    del self.stack[depth:]
                    break

    def handle_data(self, data):
        if not self.stack[-1].dropped:
            self.parts.append(data)
            self.linked += self.links * len(data.strip())

    def close(self):
        if re.match(r"<[!/?a-zA-Z]", self.rawdata):
            self.rawdata = ""
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends the kernel's inner part is used."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    width = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / width


def threshold(values: np.ndarray) -> float:
    """The cut in two clusters, between their means (two-means from the extremes); the lowest value if these hardly differ."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return float(values.min()) if 2 * low > high else (low + high) / 2


#: Width of the smoothing, share of the threshold that is enough, lines of a gap that is filled.
SIGMA, ENOUGH, GAP = 3.0, 0.6, 3


def main_text(html: str, sigma: float = SIGMA, hints: bool = True) -> str:
    """The page's content lines joined by line feeds; without ``hints`` by clustering alone."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = reader.lines
    if not lines:
        return ""
    if any(x.marks for x in lines):
        lines = unmarked(lines, reader.mains, sigma)
    if not lines:
        return ""
    ratios = ratios_of(lines, sigma)
    cut, plain = threshold(ratios), np.array([not x.marks for x in lines])
    if plain.any():  # a line in a marked container takes no other line's place
        cut = min(cut, threshold(ratios[plain]))
    return "\n".join(x.text for x in content(lines, ratios, ENOUGH * cut, hints))


def ratios_of(lines: list[Line], sigma: float) -> np.ndarray:
    return smoothed(np.array([max(len(x.text) - 2 * x.linked, 0) / x.tags for x in lines]), sigma)


def unmarked(lines: list[Line], mains: set[int], sigma: float) -> list[Line]:
    """Lines without those in marked containers, but for marks around the page's main text: around
    a main element, or, if no article stands elsewhere, around one or most of the high cluster."""
    void = set(mains)
    if not any(x.article and void.issuperset(x.marks) for x in lines):
        ratios = ratios_of(lines, sigma)
        total, within = 0, {}
        for x, high in zip(lines, ratios >= threshold(ratios)):
            if x.article:
                void.update(x.marks)
            total += high * len(x.text)
            for mark in x.marks:
                within[mark] = within.get(mark, 0) + high * len(x.text)
        void.update(mark for mark, n in within.items() if 2 * n > total)
    return [x for x in lines if void.issuperset(x.marks)]


def clustered(lines: list[Line], high: np.ndarray) -> np.ndarray:
    """Lines of the high cluster and of short gaps in it, but for those that are mostly links."""
    keep, at = high.copy(), np.flatnonzero(high).tolist()
    for a, b in zip(at, at[1:]):
        if b - a <= GAP + 1:
            keep[a:b] = True
    return keep & np.array([2 * x.linked <= len(x.text) for x in lines])


def content(lines: list[Line], ratios: np.ndarray, cut: float, hints: bool = True) -> list[Line]:
    """The lines of the main text, from their smoothed ratios and the elements they stand in."""
    high = ratios >= cut
    keep = clustered(lines, high)
    if not hints:
        return [x for x, k in zip(lines, keep.tolist()) if k]
    articles = {x.article for x, k in zip(lines, keep.tolist()) if k and x.article}
    linked: dict[int, int] = {}
    low: dict[int, int] = {}
    for x, up in zip(lines, high.tolist()):
        linked[x.container] = linked.get(x.container, 0) + 2 * x.linked - len(x.text)
        low[x.container] = low.get(x.container, 0) + (-1 if up else 1)
    lists = {x.container for x in lines if 0 < x.article != x.container and linked[x.container] > 0 and low[x.container] > 0}
    return [x for x, k in zip(lines, keep.tolist()) if x.container not in lists and (k or x.article in articles)]


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sigma: float = SIGMA
) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def run(batches):
        for batch in batches:
            found = [main_text(x or "", sigma) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(
        named(page_id).cast("bigint").alias("page_id"), named(url).alias("url"), named(html).alias("html")
    )
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
