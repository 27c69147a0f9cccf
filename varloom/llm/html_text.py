"""Main text of web pages by text-to-tag ratios (operator 4).

The standard library's parser streams events; block elements cut the page into
lines. A line's ratio is its characters per tag. The ratios are smoothed with a
Gaussian and split by a threshold; the lines above it are the dense text.

Menus, footers, asides and hidden elements are boilerplate. Elements that only a
class, id or role names as such, forms and page headers are it too, unless they
hold the content: its article or main, or more than half of the dense text.

The content region is the article or main with the most dense text. Without one
it is the lowest common container of the dense lines with words of their own, and the lines around it
belong to the text as well, except those that are nothing but links. Every line
that is no boilerplate is returned, short ones too.

Defined cases: missing and empty pages have an empty text; broken nesting is
closed as a browser would; other columns are kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
SILENT = frozenset(
    "script style noscript template head title svg math canvas iframe object audio video select option button input "
    "textarea label datalist".split()
)
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
ROOTS = frozenset("article main".split())
SECTIONS = frozenset("article main section nav aside footer header form table td th ul ol dl body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot masthead topbar toolbar header pageheader "
    "siteheader cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended comment comments commentlist disqus respond "
    "replies pagination pager copyright legal disclaimer widget search skip".split()
)
#: Start of one of these closes an open one of the set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SIGMA = 1.0
#: Marks of elements: boilerplate unless it holds the content, boilerplate.
NAMED, OUTSIDE = 1, 2
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def boilerplate(tag: str, attributes: dict, in_root: bool) -> int:
    """``OUTSIDE`` or ``NAMED`` for an element that holds no article text, else 0."""
    if tag in BOILERPLATE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return OUTSIDE
    if "display:none" in (attributes.get("style") or "").replace(" ", "").lower():
        return OUTSIDE
    if tag == "form" or tag == "header" and not in_root or (attributes.get("role") or "").lower() in ROLES:
        return NAMED
    if tag in ROOTS or tag in ("body", "html"):
        return NAMED * any(x.lower() in ("comment", "comments") for x in _TOKEN.findall(attributes.get("class") or ""))
    for name in ("class", "id"):
        value = attributes.get(name)
        if value:
            words = [x.lower() for x in _TOKEN.findall(value)]
            if any(w in NAMES for w in words) and not (in_root and "header" in words and NAMES.isdisjoint(set(words) - {"header"})):
                return NAMED
    return 0


class PageLines(HTMLParser):
    """Lines of a page: text, number of tags, container, whether it is nothing but links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []  # (tag, container, silent, inside article or main, inside a link)
        self.parents, self.names, self.marks = [-1], [""], [0]
        self.lines, self.text, self.tags, self.plain = [], [], 0, False

    def _state(self):
        return self.open[-1] if self.open else ("", 0, False, False, False)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self._state()[1], not self.plain))
        self.text, self.tags, self.plain = [], 0, False

    def _close(self, k: int) -> None:
        self._flush()
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.tags += 1
            self.text.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCK:
            closing = CLOSES.get(tag, ())
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in closing:
                    self._close(k)
                    break
                if name == "p":  # a block ends an open paragraph
                    self._close(k)
                    break
                if name in BLOCK:
                    break
            self._flush()
        self.tags += 1
        _, container, silent, in_root, link = self._state()
        attributes = dict(attrs)
        mark = 0 if silent else boilerplate(tag, attributes, in_root)
        if tag in BLOCK or mark:
            self.parents.append(container)
            self.names.append(tag)
            self.marks.append(mark)
            container = len(self.parents) - 1
        link = link or tag == "a" and "href" in attributes
        self.open.append((tag, container, silent or tag in SILENT, in_root or tag in ROOTS, link))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                if tag in BLOCK:
                    self._close(k)
                else:
                    del self.open[k:]
                return
            if name in SECTIONS and tag not in SECTIONS:
                return

    def handle_data(self, data):
        _, _, silent, _, link = self._state()
        if not silent:
            self.text.append(data)
            self.plain = self.plain or not link and any(map(str.isalnum, data))

    def unknown_decl(self, data):
        """Marked sections carry no text."""

    def finish(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    x = np.arange(-reach, reach + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def dense_lines(lines, inside: np.ndarray) -> np.ndarray:
    """Which of the lines ``inside`` reach the threshold; all others count as zero."""
    if not inside.any():
        return inside
    chars = np.array([len(text) for text, _, _, _ in lines], float)
    tags = np.array([max(1, n) for _, n, _, _ in lines], float)
    ratio = smoothed(np.where(inside, chars / tags, 0.0))
    return inside & (ratio >= min(ratio.std(), ratio[inside].max()))


def masses(lines, parents, dense: np.ndarray) -> np.ndarray:
    """Characters of the dense lines in every container."""
    mass = np.zeros(len(parents))
    for (text, _, container, _), take in zip(lines, dense):
        if take:
            mass[container] += len(text)
    for k in range(len(parents) - 1, 0, -1):  # a container comes after the one it is in
        mass[parents[k]] += mass[k]
    return mass


def inherited(parents, own) -> np.ndarray:
    """Whether a container or one around it is one of ``own``."""
    out = np.array(own, bool)
    for k in range(1, len(parents)):
        out[k] |= out[parents[k]]
    return out


def content_root(mass: np.ndarray, names, marks, inside: np.ndarray, named: np.ndarray, plain: float) -> int:
    """The article or main of the content, or -1; one in a named element weighs half.

    An article in a named element is the content only if the dense text outside
    named elements, ``plain``, is no longer.
    """
    roots = [k for k in range(len(mass)) if names[k] in ROOTS and not marks[k] and inside[k] and mass[k] > 0]
    order = sorted(roots, key=lambda k: (-mass[k] / (1 + named[k]), k))
    return next((k for k in order if not named[k] or names[k] == "main" or mass[k] >= plain), -1)


def content_lines(lines, parents, names, marks) -> list[str]:
    """The lines of the content region and around it that are no boilerplate."""
    marks, at = np.array(marks), np.array([k for _, _, k, _ in lines], int)
    inside = ~inherited(parents, marks == OUTSIDE)
    named = inherited(parents, marks == NAMED)
    dense = dense_lines(lines, inside[at])
    mass = masses(lines, parents, dense)
    plain = masses(lines, parents, dense & ~named[at])[0]
    root = content_root(mass, names, marks, inside, named, plain)
    around = np.zeros(len(parents), bool)
    k = max(root, 0)
    while k >= 0:
        around[k] = True
        k = parents[k]
    vetoed = (marks == NAMED) & ~around & (2 * mass <= mass[max(root, 0)])
    kept = inside[at] & ~inherited(parents, vetoed)[at]
    if root >= 0:
        kept &= inherited(parents, np.arange(len(parents)) == root)[at]
        return [text for (text, _, _, _), keep in zip(lines, kept) if keep]
    if not (dense & kept).any():  # all dense text is in named elements, which then tell nothing
        kept = inside[at]
    worded = kept & ~np.array([links for _, _, _, links in lines], bool)
    chosen = at[dense_lines(lines, worded if worded.any() else kept)]
    held = np.bincount(chosen, minlength=len(parents))
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
    region = int(np.flatnonzero(held == len(chosen))[-1])  # the containers of all chosen lines are nested
    within = inherited(parents, np.arange(len(parents)) == region)
    heading = inherited(parents, [name in HEADINGS for name in names])
    return [
        text for (text, _, k, links), keep in zip(lines, kept) if keep and (within[k] or heading[k] or not links)
    ]


def main_text(html: str | None) -> str:
    page = PageLines()
    lines = page.finish(html or "")
    return "\n".join(content_lines(lines, page.parents, page.names, page.marks)) if lines else ""


def _extract(column: str):
    def run(batches):
        for batch in batches:
            pages = batch.column(column)
            rest = [c for c in batch.schema.names if c != column]
            texts = []
            for start in range(0, len(pages), 64):
                texts += [main_text(x) for x in pages.slice(start, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "_main"]
            )

    return run


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the html replaced by ``_main``, the main text of the page."""
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name != html)
    return pages.mapInArrow(_extract(html), rest + "_main string")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars."""
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars")
    )
