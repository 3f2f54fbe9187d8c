"""The main text of web pages by their line-block distribution.

Markup is stripped into lines, one per block element.  Menus, adverts, forms
and other page furniture leave empty lines behind, link text does not count,
and where a page names its article or main part, lines outside count nothing.
Over the line lengths a sliding window is summed: the text surges where the
window first reaches the needed length and dives where it last falls below
it.  Every line between the two points is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 40

# Element names by role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section summary table
tbody td tfoot th thead title tr ul""".split())
FURNITURE = frozenset("nav header footer aside form noscript template iframe svg button select object dialog menu head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role names of page furniture.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond reply
replies disqus share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget
toolbar pagination pager masthead login signup search complementary contentinfo""".split())

# First words of names that tell whether something stands beside an element.
LAYOUT = frozenset("with without no has not".split())

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Line:
    """The text of one block, how much of it counts, and whether it lies in the page's article."""

    text: str
    plain: int
    inside: bool


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE:
        return not (name == "header" and inside)
    if not attributes or name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    if name == "article" and not inside:
        return False  # a page's own article, whatever its class says of the page's layout
    named = " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)).lower()
    # "with-sidebar" says something of the element's surroundings
    words = [_WORD.findall(one) for one in named.split()]
    return any(MARKS.intersection(w) for w in words if w and w[0] not in LAYOUT)


def lines(page: str) -> list[Line]:
    """The page's blocks in order; furniture leaves an empty line."""
    out: list[Line] = []
    text: list[str] = []
    plain, links, article, at = 0, 0, 0, 0
    skipping, depth = "", 0

    def cut() -> None:
        nonlocal plain
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Line(joined, plain, article > 0))
        text.clear()
        plain = 0

    while at < len(page):
        piece = _PIECE.search(page, at)
        end = piece.start() if piece else len(page)
        if end > at and not skipping:
            said = html.unescape(page[at:end])
            text.append(said)
            plain += 0 if links else len(said.strip())
        if piece is None:
            break
        at = piece.end()
        name = (piece[2] or piece[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(piece[1] or piece[4]), piece[3] or piece[6] or ""
        if name in RAW and not closing:
            close = re.compile(f"</{name}\\b", re.IGNORECASE).search(page, at)
            at = close.start() if close else len(page)
            continue
        if skipping:
            if skipping in ("p", "li") and name in BLOCKS:
                depth = 0  # the next block ends these without a tag
            elif name == skipping:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
            if depth > 0:
                continue
            ended, skipping = skipping, ""
            if closing and name == ended:
                continue
        if name in BLOCKS:
            cut()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in ("article", "main"):
                article = max(0, article - 1)
            continue
        if name == "br":
            text.append(" ")
        elif name not in VOID and _is_furniture(name, attributes, article > 0):
            cut()
            out.append(Line("", 0, article > 0))
            skipping, depth = name, 1
        elif name == "a":
            links += 1
        elif name in ("article", "main"):
            article += 1
    cut()
    return out


def main_lines(found: list[Line], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """The surge and dive points: the lines ``[surge, dive)`` hold the main text.

    Inside a named article any text counts; elsewhere a window must reach
    ``surge`` characters outside links, or, where none does, the most that any has.
    """
    named = any(x.inside and x.text for x in found)
    size = np.array([(len(x.text) if x.inside else 0) if named else x.plain for x in found], np.int64)
    if not size.any():
        return 0, 0
    sums = np.convolve(size, np.ones(window, np.int64))[window - 1:]
    need = 1 if named else min(surge, int(sums.max()))
    dense = np.flatnonzero(sums >= need)
    begin, end = int(dense[0]), min(len(size), int(dense[-1]) + window)
    filled = np.flatnonzero(size[begin:end])
    return begin + int(filled[0]), begin + int(filled[-1]) + 1


def main_text(page: str | None) -> tuple[str, int]:
    """The main text, one line per block, and the number of its blocks."""
    found = lines(page or "")
    begin, end = main_lines(found)
    named = any(x.inside and x.text for x in found)
    kept = [x.text for x in found[begin:end] if x.text and (x.inside or not named)]
    return "\n".join(kept), len(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` for every row of ``pages (page_id, url, html)``.

    Null, empty and text-less pages give an empty text.  Nulls in the other
    columns stay, rows may repeat, whole pages are read, and extra columns are
    ignored.  Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()),
                 pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
