"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadweave.llm.common import arrow_rows

_SKIPPED = frozenset("head title script style noscript template svg annotation annotation-xml canvas iframe object select option button textarea datalist audio video".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
_CONTENT = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary".split())
_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "login menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related reply replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names of what readers write, which stays out however long it is.
_READERS = frozenset("comment comments disqus reply replies respond".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Words that make a class the state of an element: what it has or lacks, not what it is.
_STATE_FIRST = frozenset("has have no not with without".split())
_STATE_LAST = frozenset("open opened closed enabled disabled allowed on off free less".split())
#: Elements that a start tag ends if they are open in the same block, besides paragraphs, which every block ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: An element's text is shown, left out only because of a form around it (which may hold a whole page), or left out.
_SHOWN, _FORM, _OUT = 0, 1, 2
SIGMA = 1.0


def _names(attrs: list) -> tuple[set[str], set[str]]:
    """Words of class, id and role that say what an element is: all of them, and those that stand alone."""
    out, alone = set(), set()
    for k, v in attrs:
        for token in (v or "").split() if k in ("class", "id", "role") else ():
            found = [n.lower() for n in _NAME.findall(token)]
            if found and found[0] not in _STATE_FIRST and found[-1] not in _STATE_LAST:
                out.update(found)
                alone.update(found if len(found) == 1 else ())
    return out, alone


class _Line(NamedTuple):
    """A block's text with its number of tags and linked characters."""

    text: str
    tags: int
    linked: int
    heading: bool
    content: int  # number of its content element, 0 outside
    parent: int  # number of the block that holds its paragraph, heading or item
    named: tuple[int, ...]  # numbers of the elements around it that their names alone leave out


class _Open(NamedTuple):
    tag: str
    out: int
    content: int
    parent: int
    named: tuple[int, ...]


class _Lines(HTMLParser):
    """Blocks of a page as lines; those that only names leave out are marked, what tags leave out is not there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Open] = [_Open("", _SHOWN, 0, 0, ())]
        self.readers: set[int] = set()  # numbers of elements with what readers write
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.contents = self.elements = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            within = self.open[-1]
            self.lines.append(_Line(text, self.tags, self.linked, self.heading, within.content, within.parent, within.named))
            self.tags = self.linked = 0
        self.text, self.heading = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self.flush()
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _BLOCKS:
            self._close({"p"}, {"p"})  # an open paragraph ends here
            if tag in _ENDS:
                self._close(_ENDS[tag], _ENDS[tag])
        self.elements += 1
        _, out, content, parent, named = self.open[-1]
        parent = self.elements if tag in _BLOCKS and tag not in _LEAVES else parent
        names, alone = _names(attrs)
        if tag in _CONTENT and not alone & _NAMES:
            # a form around the whole page doesn't hide its article
            out = _OUT if out == _OUT else _SHOWN
            if not content:
                self.contents += 1
                content = self.contents
        elif tag not in ("html", "body"):
            if tag in _SKIPPED or (tag in _BOILERPLATE and tag != "form") or (tag == "header" and not content):
                out = _OUT
            elif names & _NAMES:
                named = (*named, self.elements)
                if names & _READERS or alone & _NAMES:
                    self.readers.add(self.elements)
            elif tag == "form":
                out = max(out, _FORM)
        self.links += tag == "a"
        self.heading |= tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        self.open.append(_Open(tag, out, content, parent, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close(self, tags: set[str], within: set[str] | None = None) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.links -= sum(e.tag == "a" for e in self.open[i:])
                del self.open[i:]
                return
            if within and self.open[i].tag in _BLOCKS and self.open[i].tag not in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        self.tags += 1
        self._close({tag})

    def handle_data(self, data: str) -> None:
        if not self.open[-1].out:
            self.text.append(data)
            self.linked += len(data) * (self.links > 0)

    def shown(self) -> list[_Line]:
        """The lines without those that names leave out.

        A name made of several words does not leave out an element with most of the unlinked text of the page, as
        "search-results" around an article; what readers write, and a name that stands alone, always do.
        """
        most = sum(max(0, len(x.text) - x.linked) for x in self.lines if not self.readers & set(x.named)) / 2
        held: Counter[int] = Counter()
        for x in self.lines:
            for e in x.named:
                held[e] += max(0, len(x.text) - x.linked)
        hidden = self.readers | {e for e, n in held.items() if n <= most}
        return [x for x in self.lines if hidden.isdisjoint(x.named)]


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = np.arange(-3, 4)
    weights = np.exp(-(reach**2) / (2 * SIGMA**2))
    return np.convolve(x, weights, "full")[3:-3] / np.convolve(np.ones(len(x)), weights, "full")[3:-3]


def _threshold(x: np.ndarray) -> float:
    """The value between the two clusters of x (two means)."""
    cut = float(x.mean())
    for _ in range(50):
        low, high = x[x < cut], x[x >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) else cut
        if new == cut:
            break
        cut = float(new)
    return cut


def main_text(html: str | None) -> str:
    """The blocks of the content regions, joined by line ends.

    A line's ratio is its unlinked characters by its tags. Smoothed ratios (in logarithms) fall into two clusters, and
    runs of the upper one are content regions. A region inside article or main elements extends to that element's other
    lines, so that short paragraphs and headings stay; lines outside such elements are candidates too. Elsewhere, it takes
    headings before it, gaps of up to two lines, and the other unlinked lines of a block that it fills by most of its text.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.shown()
    if not lines:
        return ""
    own = np.array([max(0, len(x.text) - x.linked) for x in lines])
    smooth = _smooth(np.log1p(own / np.array([max(1, x.tags) for x in lines])))
    chosen = smooth >= _threshold(smooth) - 1e-9
    elements = {lines[i].content for i in np.flatnonzero(chosen)}
    keep = chosen | np.array([x.content > 0 and x.content in elements for x in lines])
    picked = np.flatnonzero(keep)
    for a, b in zip(picked, picked[1:], strict=False):
        if b - a <= 3:
            keep[a:b] = True
    full, filled = Counter(), Counter()
    for x, n, k in zip(lines, own.tolist(), keep, strict=True):
        full[x.parent] += n
        filled[x.parent] += n * bool(k)
    for i, x in enumerate(lines):
        keep[i] |= 2 * x.linked < len(x.text) and 2 * filled[x.parent] > full[x.parent]
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= lines[i].heading and keep[i + 1]
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per page; n_chars counts code points.

    Null and empty pages, and pages without text, give an empty text. Null keys and addresses are kept, repeated rows
    are extracted each, whole pages of any length are read, an empty table gives no rows, and other columns are not read.
    Unclosed and stray tags, comments and character references are handled as the standard library's parser does.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_rows(pages.select(key, url, html), f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long", make)
