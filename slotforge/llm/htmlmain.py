"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end or start ends a line (fixed values: HTML's block elements).
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Blocks that are a line of running text rather than a part of the page.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th legend summary address".split())
#: Elements that never hold the article's words; a header does if it stands in the article.
OUTSIDE = frozenset("head title script style noscript template nav header footer aside menu form button select textarea input iframe object embed svg canvas audio video map dialog datalist search".split())
#: Names that mark an element as beside the article, alone or with each other or with a FILLER.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer sidebar related recommended trending share sharing social "
    "comment comments commentlist reply replies respond discussion disqus subscribe subscription newsletter signup login search toolbar skip complementary contentinfo dialog".split()
)
FILLER = frozenset("site page main global top bottom left right primary secondary box bar area list item items block section wrapper wrap container inner outer holder group panel unit slot link links button buttons form widget widgets posts articles stories thread message text body row".split())
_SPLIT = re.compile(r"[_\-]+|(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_TAG = re.compile(r"</?[A-Za-z]|<[!?]|</$")
#: Start tag: the open elements it closes, and those that the search for one stops at (fixed values: HTML's optional end tags).
_P = (frozenset(["p"]), frozenset("td th caption button object template".split()))
CLOSES = dict.fromkeys(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul summary".split(), _P
) | {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir td th".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
IN_HEAD = frozenset("title meta link script style base noscript template html head".split())
SIGMA = 1.5
MOST = 0.9  #: share of the marked text that a part of the page must hold to be the region by itself
TAGGED, NAMED = 2, 1  #: an element beside the article by its tag, by its class, id or role


def named_beside(value: str) -> bool:
    """Whether a class, id or role names something beside the article: every part of the name must, so ``no-sidebar`` or ``comments-open`` does not."""
    for name in value.split():
        parts = [x.lower() for x in _SPLIT.split(name) if x]
        if parts and not BESIDE.isdisjoint(parts) and all(x in BESIDE or x in FILLER or x.isdigit() for x in parts):
            return True
    return False


class _Line:
    __slots__ = ("text", "tags", "linked", "node")

    def __init__(self, node: int):
        self.text: list[str] = []
        self.tags, self.linked, self.node = 0, 0, node


class Events(HTMLParser):
    """Turns a stream of parser events into lines (text, tags, link characters, element) and a tree of the elements that part them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.parent, self.tag, self.hint = [0], ["html"], [0]  # of elements; the first is the page
        self.open: list[tuple[str, int]] = []  # tag, element that text in it belongs to
        self.depth: dict[str, int] = {}  # open elements by tag, so that a stray end tag costs no search
        self.stories = 0
        self.line = _Line(0)

    def _end_line(self) -> None:
        node = self.open[-1][1] if self.open else 0
        if any(map(str.strip, self.line.text)):
            self.lines.append(self.line)
            self.line = _Line(node)
        else:
            self.line.node = node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depth.get("head") and tag not in IN_HEAD:
            self._close_tag("head")
        if tag in CLOSES:
            shut, stops = CLOSES[tag]
            if any(self.depth.get(t) for t in shut):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in shut:
                        self._close(i)
                        break
                    if self.open[i][0] in stops:
                        break
        hint = 0
        if tag in OUTSIDE:
            hint = 0 if tag == "header" and self.stories else TAGGED
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                hint = TAGGED
            elif not hint and value and name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and named_beside(value):
                hint = NAMED
        node = self.open[-1][1] if self.open else 0
        parts = tag in BLOCK or hint
        if parts and tag not in VOID:
            self.parent.append(node)
            self.tag.append(tag)
            self.hint.append(hint)
            node = len(self.parent) - 1
        if tag not in VOID:
            self.open.append((tag, node))
            self.depth[tag] = self.depth.get(tag, 0) + 1
            self.stories += tag in ("article", "main")
        if parts:
            self._end_line()
        self.line.tags += 1
        if tag in ("title", "textarea"):
            self.set_cdata_mode(tag)  # what looks like a tag or a comment there is none

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:  # HTML ignores the slash; inline elements hold nothing then
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.depth.get(tag):
            self._close_tag(tag)
        elif tag in BLOCK:
            self._end_line()

    def _close_tag(self, tag: str) -> None:
        self._close(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag))

    def _close(self, i: int) -> None:
        was = self.open[-1][1]
        shut = self.open[i:]
        del self.open[i:]
        for tag, _ in shut:
            self.depth[tag] -= 1
            self.stories -= tag in ("article", "main")
        if was != (self.open[-1][1] if self.open else 0):
            self._end_line()
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        self.line.text.append(data)
        if self.depth.get("a"):
            self.line.linked += len(data)

    def finish(self) -> None:
        """The end of the page. A comment or a tag that is still open there is no text, as in browsers."""
        if _TAG.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._end_line()


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers: midpoint of their means, found from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(over):
            return cut
        a, b = float(under.mean()), float(over.mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    sums = np.convolve(values, kernel)[reach : reach + len(values)]
    return sums / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def _above(parent: list[int], sums: list) -> list:
    """Sums over the elements below each element, itself included (an element follows its parent)."""
    out = list(sums)
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def beside(page: Events, sizes: list[int]) -> list[bool]:
    """For each element whether it stands beside the article.

    A class, id or role counts unless the element is a wrapper: it holds
    every <article> and <main> of the page, or, in a page without, MOST of
    the text that stands in no element that is outside by its tag.
    """
    count = len(page.parent)
    tagged = [False] * count
    for k in range(1, count):
        tagged[k] = tagged[page.parent[k]] or page.hint[k] == TAGGED
    own = [0] * count
    for line, size in zip(page.lines, sizes, strict=True):
        if not tagged[line.node]:
            own[line.node] += max(0, size - line.linked)
    held = _above(page.parent, own)
    stories = _above(page.parent, [int(not tagged[k] and page.tag[k] in ("article", "main")) for k in range(count)])
    out = [False] * count
    for k in range(1, count):
        wraps = stories[k] == stories[0] if stories[0] else held[k] >= MOST * held[0]
        out[k] = out[page.parent[k]] or page.hint[k] == TAGGED or page.hint[k] == NAMED and not wraps
    return out


def densities(page: Events, sizes: list[int], out: list[bool]) -> np.ndarray:
    """Log of each line's text outside links per tag; 0 beside the article."""
    return np.log1p(np.array([0.0 if out[line.node] else max(0, size - line.linked) / max(1, line.tags) for line, size in zip(page.lines, sizes, strict=True)]))


def main_text(html: str) -> str:
    """The article's lines, joined by blanks.

    A line's ratio is its text outside links per tag; what stands beside the
    article by tag or by class (menus, adverts, comments and the like) weighs
    nothing. The log ratios are smoothed over the page and cut into two
    clusters; the higher one marks the content. From the page down, the
    region is the smallest part that still has MOST of the marked text; an
    <article> or <main> needs half of it. An article is taken whole; of
    another part, what lies from the first to the last marked line, with
    the lines next to these in the same element and the <h1> before them.
    Lines beside the article are left out, and so are runs of three or more
    unmarked lines of links. A page without any marked line keeps all others.
    """
    page = Events()
    page.feed(html)
    page.finish()
    lines = page.lines
    if not lines:
        return ""
    texts = [_SPACES.sub(" ", "".join(line.text)).strip(" ") for line in lines]
    sizes = list(map(len, texts))
    out = beside(page, sizes)
    level = smoothed(densities(page, sizes, out))
    marked_at = level >= two_means(level)
    keep = [i for i, line in enumerate(lines) if texts[i] and not out[line.node]]
    marked = [i for i in keep if marked_at[i]] or keep
    return " ".join(texts[i] for i in region(page, sizes, keep, marked))


def region(page: Events, sizes: list[int], keep: list[int], marked: list[int]) -> list[int]:
    """The lines of ``keep`` that belong to the article, whose marked lines are known."""
    if not keep:
        return []
    lines, parent, tag = page.lines, page.parent, page.tag
    own, rows = [0] * len(parent), [0] * len(parent)
    for i in marked:
        own[lines[i].node] += sizes[i]
    for i in keep:
        rows[lines[i].node] += 1
    weight, rows = _above(parent, own), _above(parent, rows)
    place, story = 0, False
    for wanted in ("article", "main"):
        best = max((k for k in range(1, len(parent)) if tag[k] == wanted), key=lambda k: (weight[k], -k), default=0)
        if best and 2 * weight[best] >= weight[0]:
            place, story = best, wanted == "article"
            break
    children: dict[int, list[int]] = {}
    for k in range(1, len(parent)):
        if weight[k]:
            children.setdefault(parent[k], []).append(k)
    while not story and place in children:
        best = max(children[place], key=lambda k: (weight[k], -k))
        if weight[best] < MOST * weight[place] or tag[best] in RUNNING or rows[best] < min(2, rows[place]):
            break
        place = best
    inside = [False] * len(parent)
    for k in range(len(parent)):
        inside[k] = k == place or (k > 0 and inside[parent[k]])
    held = [i for i in keep if inside[lines[i].node]]
    if story:
        return held

    def part(i: int) -> int:
        return parent[lines[i].node] if tag[lines[i].node] in RUNNING else lines[i].node

    def links(i: int) -> bool:
        return 5 * lines[i].linked >= 4 * sizes[i]

    sure = set(marked)
    at = [x for x, i in enumerate(held) if i in sure]
    first, last = at[0], at[-1]
    while first and part(held[first - 1]) == part(held[first]) and not links(held[first - 1]):
        first -= 1
    while last + 1 < len(held) and part(held[last + 1]) == part(held[last]) and not links(held[last + 1]):
        last += 1
    chosen, run = [], []
    for i in [*held[first : last + 1], None]:
        if i is not None and links(i) and i not in sure:
            run.append(i)
            continue
        if len(run) < 3:
            chosen += run
        run = []
        if i is not None:
            chosen.append(i)
    if not any(tag[lines[i].node] == "h1" for i in chosen):
        before = [i for i in keep if i < chosen[0] and tag[lines[i].node] == "h1" and not links(i)]
        chosen = before[-1:] + chosen
    return chosen


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row per page; null or empty html gives an empty text. Repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((t or b"").decode("utf-8", "replace")) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "id long, url string, text string, n_chars long")
