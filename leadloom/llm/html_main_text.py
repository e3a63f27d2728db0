"""Main text of web pages from parser events and the ratio of text to tags.

The standard library's parser streams events once over a page. Text goes to lines: a line ends where a block
begins or ends. Lines inside navigation, headers, footers, sidebars, adverts, notices and comments are never
content, whether an element or a class says so. For the others the ratio of text to tags is smoothed by a Gaussian over
neighbouring lines, and two clusters of the smoothed ratios, split at the threshold between their means, tell
content from the rest. A region is what one container encloses (``article``, ``main``, or else the nearest section or
division). A region with a line in the content cluster is kept whole. Of the others those go that hold mostly links, or
controls of a form; short paragraphs stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import slices

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "aside button canvas datalist dialog embed fieldset footer head header iframe input menu nav noscript object "
    "select script style svg template textarea title".split()
)
CLOSES_P = BLOCK - {"br", "option"}
CONTROLS = frozenset("button input select textarea".split())
#: Words of class and id names (and role values) of what is no part of an article. A name counts when it has one of
#: these and no other words than these and ``AROUND``: ``site-footer`` does, ``has-sidebar`` and ``ad-hoc`` do not.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup "
    "promo promotion related replies reply respond share sharing sidebar sidenav signup social sponsor sponsored subscribe "
    "toc toolbar widget alert complementary contentinfo search topbar consent".split()
)
AROUND = frozenset(
    "a area bar block bottom box button buttons container fixed global group heading holder icons inner item items left "
    "link links list main middle outer page panel primary right row secondary section site slot sticky title top "
    "unit wrap wrapper x zone".split()
)
#: Names of reader comments, which may be longer than the article.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Share of a region's characters in links from which it is no text.
LINKED = 0.5
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset("div section td".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SIGMA = 1.0


class _Line:
    """A line of text: its region, the innermost doubt it stands in, and what it holds."""

    __slots__ = ("region", "doubt", "tags", "linked", "text")

    def __init__(self, region: int, doubt: int, tags: int, linked: int, text: str):
        self.region, self.doubt, self.tags, self.linked, self.text = region, doubt, tags, linked, text


class _Lines(HTMLParser):
    """The lines of a page; time grows with its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, int, int]] = []  # element, its region or 0, its doubt or 0
        self.counts: dict[str, int] = {}  # open elements by name
        self.skipping: list[int] = []  # depths in ``open`` that began something skipped
        self.region = [0]
        # By region: the one around it, whether an article or main element holds it, whether it has controls.
        self.around, self.marked, self.controls = [0], [False], [False]
        # What a name or a form puts in doubt: the doubt around it, and whether it may be all there is to the page.
        self.doubt = [0]
        self.within, self.may_be_all = [0], [True]
        self.any_marked = False
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(_Line(self.region[-1], self.doubt[-1], self.tags, min(self.linked, len(text)), text))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
        if tag in REGIONS and self.skipping and not self.any_marked:
            # Something skipped was never closed: the first article is no part of it.
            while self.skipping:
                self._close_at(self.skipping[-1])
        if tag in CLOSES_P and any(t == "p" for t, *_ in self.open[-8:]):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self._close_at(at)
                    break
                if self.open[at][0] in BLOCK:
                    break
        if not self.skipping:
            self.tags += 1
            if tag in CONTROLS:
                self.controls[self.region[-1]] = True
        if tag in VOID:
            return
        made = doubt = 0
        if not self.skipping:
            if tag in SKIPPED or any(n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attrs):
                self.skipping.append(len(self.open))
            else:
                named = self._named(tag, attrs)
                if tag == "form" or named:
                    self.within.append(self.doubt[-1])
                    self.may_be_all.append(not named & COMMENTS)
                    doubt = len(self.within) - 1
                    self.doubt.append(doubt)
                inside = self.marked[self.region[-1]]
                if tag in REGIONS or tag in CONTAINERS and not inside:  # what an article encloses is one region
                    self.around.append(self.region[-1])
                    self.marked.append(inside or tag in REGIONS)
                    self.controls.append(False)
                    self.any_marked |= tag in REGIONS
                    made = len(self.around) - 1
                    self.region.append(made)
        self.open.append((tag if tag != "a" or any(n == "href" for n, _ in attrs) else "a-name", made, doubt))
        self.counts[self.open[-1][0]] = self.counts.get(self.open[-1][0], 0) + 1

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        """The words of a name that makes the element no part of an article."""
        if tag in ("html", "body") or tag in REGIONS and not self.any_marked:
            return set()  # later articles may be reader comments or adverts
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    words = {w.lower() for w in WORDS.findall(one)}
                    if words & NAMES and words <= NAMES | AROUND:
                        return words & NAMES
        return set()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element that is not void

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += not self.skipping
        names = ("a", "a-name") if tag == "a" else (tag,)
        if not any(self.counts.get(n) for n in names):
            return
        for at in range(len(self.open) - 1, -1, -1):  # what it passes is closed, so no element is passed twice
            if self.open[at][0] in names:
                self._close_at(at)
                return

    def _close_at(self, at: int) -> None:
        for tag, made, doubt in reversed(self.open[at:]):
            self.counts[tag] -= 1
            if made or doubt:
                self._end_line()
            if made:
                self.region.pop()
            if doubt:
                self.doubt.pop()
        del self.open[at:]
        while self.skipping and self.skipping[-1] >= at:
            self.skipping.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.counts.get("a"):
                self.linked += len(data)

    def finish(self) -> list[_Line]:
        """All lines but those in doubt; what is named after layout or is a form stays where it holds most of the text."""
        self.close()
        self._end_line()
        held = [0] * len(self.within)
        for line in self.lines:
            held[line.doubt] += len(line.text)
        for doubt in range(len(held) - 1, 0, -1):
            held[self.within[doubt]] += held[doubt]
        gone = [False] * len(held)
        for doubt in range(1, len(held)):
            most = 2 * held[doubt] > held[0] and self.may_be_all[doubt]
            gone[doubt] = gone[self.within[doubt]] or not most
        return [line for line in self.lines if not gone[line.doubt]]


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing, with weights renewed at both ends."""
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        own = weights[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(own, ratios[low:high])) / sum(own))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters of values, found by repeated assignment."""
    low, high = min(values), max(values)
    if low == high:
        return low
    cut = (low + high) / 2
    for _ in range(50):
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(below) / max(1, len(below)) + sum(above) / max(1, len(above))) / 2
        if not below or not above or abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def content_regions(parser: _Lines, lines: list[_Line]) -> set[int]:
    """The regions of ``lines`` that are content.

    Those with a line in the upper cluster of smoothed ratios are, and of the others all but those that are mostly
    links or hold controls and little else; of these the ones between two content regions of one container
    stay. Where a page marks articles, nothing outside them is content.
    """
    marked = any(parser.marked[line.region] for line in lines)
    if marked:
        lines = [line for line in lines if parser.marked[line.region]]
    smooth = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    cut = threshold(smooth)
    upper: dict[int, bool] = {}
    chars: dict[int, list[int]] = {}
    for line, value in zip(lines, smooth):
        upper[line.region] = upper.get(line.region, False) or value >= cut
        sums = chars.setdefault(line.region, [0, 0])
        sums[0] += len(line.text)
        sums[1] += line.linked
    linked = {r for r, (n, own) in chars.items() if own > LINKED * n}
    chosen = {r for r in upper if upper[r] or r not in linked and (marked or not parser.controls[r])}
    # Regions stand in the order of their first lines.
    order, seen, last = list(upper), {}, {}
    for at, r in enumerate(order):
        if r in chosen:
            seen.setdefault(parser.around[r], at)
            last[parser.around[r]] = at
    between = {r for at, r in enumerate(order) if seen.get(parser.around[r], at) < at < last.get(parser.around[r], at)}
    return chosen | between


def main_text(html: str) -> str:
    """The main text of one page; empty if none."""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    regions = content_regions(parser, lines)
    return " ".join(line.text for line in lines if line.region in regions)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages (page_id, url, html)``.

    Null or empty html, and html without text, give an empty text. Cut-off pages count as far as they go.
    Repeated rows repeat, an empty table gives no rows, other columns are not read. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                texts = [main_text(h) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    some.column("page_id").cast(pa.int64()), some.column("url").cast(pa.string()),
                    pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                ], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, SCHEMA)
