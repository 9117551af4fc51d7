"""HTML extraction: parser events to lines, text-to-tag ratios, smoothing, clustering, regions.

The standard library's parser feeds events. Block elements end lines; each line has its text, its
number of tags and its place in the tree. Lines within menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are out. The ratio of text to tags of the other lines is
smoothed with a Gaussian; lines over the threshold (the ratios' standard deviation, or their largest
value if that is smaller) are the content's core. The regions are the article and main elements with
core; one whose core lies wholly in such elements within it gives way to them. Of these, the ones stay
of whose text at least half is core (if none is so, the one with the most core), so that several
articles are all kept and lists of links or teasers that are marked as articles aren't. On a page
without such elements, the region is the innermost element that holds all of the core and is no mere
part of a text, as sections, lists and tables are. All lines of the regions that are not out are the
result, in page order, so that short paragraphs between long ones stay.

A null or empty page, or one without text outside of what is out, gives the empty string. Very long
pages are parsed in pieces and whole. Repeated rows give repeated results; ties between elements go
to the earlier one. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that never hold content.
OUT = frozenset(
    "head title script style noscript template svg math iframe object embed canvas audio video map nav header footer aside form button select textarea input option datalist dialog menu".split()
)
#: Elements whose start and end end a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these, as far up as the stop elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of class names, ids and roles that tell what is no content.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs toc pagination pager topbar toolbar
    sidebar sidebars side aside rail related recommended recommendations trending popular
    header masthead footer foot bottom copyright colophon
    comment comments commentlist discussion disqus replies reply respond
    cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login
    share sharing social follow widget widgets search skip hidden legal disclaimer
    complementary contentinfo navigation dialog form""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies related recommended".split())
CONTENT = frozenset("article content main post entry story".split())
HEADS = frozenset("header masthead side legal".split())
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
RADIUS, SIGMA = 2, 1.0
#: Elements that are parts of a text.
PARTS = frozenset("p li td th tr tbody thead tfoot caption table ul ol dl dt dd dir blockquote pre address details summary figure figcaption h1 h2 h3 h4 h5 h6 hgroup section".split())


def noisy(value: str, tag: str, inside: bool) -> bool:
    """Whether a class, id or role names something that is no content.

    Names of the content itself outweigh names of what may stand around it ("content with-sidebar"),
    but not names of comments. Inside an article, a header is the article's own.
    """
    parts = {p.lower() for p in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))}
    if parts & COMMENTS:
        return True
    if tag == "article" or parts & CONTENT:
        return False
    return bool(parts & (NOISE - HEADS if inside else NOISE))


class Lines(HTMLParser):
    """Collects lines: text parts, number of tags, number of the innermost block element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, out
        self.parent = [-1]
        self.tags = [""]
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.count = 0

    def end_line(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.count, self.stack[-1][1]))
                self.count = 0
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        if tag in VOID:
            self.count += 1
            return
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                t = self.stack[k][0]
                if t in stops:
                    break
                if t in ends:
                    self.pop(k)
                    break
        elif tag in BLOCK:
            for k in range(len(self.stack) - 1, 0, -1):  # a block ends an open paragraph
                if self.stack[k][0] == "p":
                    self.pop(k)
                    break
                if self.stack[k][0] in BLOCK:
                    break
        _, element, out = self.stack[-1]
        self.count += not out
        if not out:
            if tag == "header":
                out = not any(t in ("article", "main") for t, _, _ in self.stack)
            elif tag in OUT:
                out = True
            if not out and attrs and tag not in ("html", "body", "main"):
                for name, value in attrs:
                    if name == "hidden" or (value and (name in ("class", "id", "role") and noisy(value, tag, any(t in ("article", "main") for t, _, _ in self.stack)) or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))):
                        out = True
                        break
        if tag in BLOCK and not out:
            self.parent.append(element)
            self.tags.append(tag)
            element = len(self.parent) - 1
        self.stack.append((tag, element, out))

    def pop(self, k: int) -> None:
        if any(t in BLOCK for t, _, _ in self.stack[k:]):
            self.end_line()
        del self.stack[k:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.stack[-1][2]:
            self.count += 1
        inline = tag not in BLOCK
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k][0]
            if t == tag:
                self.pop(k)
                return
            if inline and t in BLOCK:
                break  # an inline end tag doesn't end blocks
        if not inline:
            self.end_line()

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.text.append(data)


def ratios(lines: list[tuple[str, int, int]]) -> list[float]:
    """The smoothed text-to-tag ratio of each line."""
    raw = [len(text) / max(1, count) for text, count, _ in lines]
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(raw)):
        total = weight = 0.0
        for d, w in zip(range(i - RADIUS, i + RADIUS + 1), kernel):
            if 0 <= d < len(raw):
                total += w * raw[d]
                weight += w
        out.append(total / weight)
    return out


def threshold_of(smooth: list[float]) -> float:
    """What parts content lines from others: the ratios' standard deviation, or their largest value if that is smaller."""
    mean = sum(smooth) / len(smooth)
    return min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))


def regions(parser: Lines) -> list[int]:
    """The elements whose lines are the content, in page order; none holds another."""
    smooth = ratios(parser.lines)
    threshold = threshold_of(smooth)
    core, text_of = [0] * len(parser.parent), [0] * len(parser.parent)
    for (text, _, element), x in zip(parser.lines, smooth):
        core[element] += len(text) if x >= threshold else 0
        text_of[element] += len(text)
    for e in range(len(core) - 1, 0, -1):  # children come after their parents
        core[parser.parent[e]] += core[e]
        text_of[parser.parent[e]] += text_of[e]
    named: list[list[int]] = [[] for _ in core]  # the nearest article and main elements with core under each named one; under 0, the outermost
    over = [0] * len(core)
    for e in range(1, len(core)):
        over[e] = over[parser.parent[e]]
        if parser.tags[e] in ("article", "main") and core[e]:
            named[over[e]].append(e)
            over[e] = e
    found, open_ = [], named[0][::-1]
    while open_:
        e = open_.pop()
        if named[e] and sum(core[c] for c in named[e]) == core[e]:
            open_.extend(reversed(named[e]))
        else:
            found.append(e)
    if found:
        return [e for e in found if core[e] * 2 >= text_of[e]] or [max(found, key=core.__getitem__)]
    return [max((e for e in range(len(core)) if core[e] == core[0] and parser.tags[e] not in PARTS), default=0)]


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    at = set(regions(parser))
    inside = [False] * len(parser.parent)
    for e in range(len(inside)):  # parents come before their children
        inside[e] = e in at or (parser.parent[e] >= 0 and inside[parser.parent[e]])
    return " ".join([text for text, _, element in parser.lines if inside[element]])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            texts = [extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
