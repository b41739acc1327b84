"""Main text of web pages by line-block distribution.

Markup is stripped to one line a block element. Between two lines stand blank lines: one between neighbours in a container,
two where the container changes, GAP where an article or main element begins or ends; and each line of an element that is
marked as beside the article (menus, headers, footers, sidebars, notices, adverts, forms, comments) is a blank line too,
unless it lies inside the container of both neighbours. A division of one line beside one of several is taken for another
region, and GAP blank lines part them, unless the one line is a heading. A line weighs its characters outside links, inside an article all of
them. The weights are summed over a sliding window of WIDTH lines. Text surges where the sum reaches SURGE of the page's
highest one, and it dives where the sum is nothing; of the stretches between two dives that surge, that with the most
text is kept, with the lines of its own container. What is marked within it is left out.

Cases: null and empty html, and pages without text, give an empty text; on a page of links alone these count as text; html
is read whole, also when it is cut off or its tags aren't closed; character references are decoded once; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

WIDTH = 5  # lines in a window
GAP = 5  # blank lines between regions
SURGE = 0.5  # share of the page's highest window sum at which the text surges

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|button|iframe|svg|title|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input picture source link meta area col math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split())
_CONTAINER = frozenset("html body main article section div aside nav header footer form ul ol dl table tbody thead tfoot tr td th figure details dialog fieldset menu center blockquote address hgroup search".split())
_DROP = frozenset("head nav aside footer form menu dialog search header".split())
_TOP = frozenset("html body".split())
#: Words of a class or id that mark an element wherever it is.
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr sidebar sidebars menu menubar nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus respond replies social sharing newsletter subscribe subscription popup modal overlay".split()
)
#: Those that mark it outside articles, and inside if they are the whole name.
_WEAK = frozenset("banner notice notification alert header topbar bottombar reply share related recommended widget widgets login signup search pagination pager disclaimer copyright skip tagcloud".split())
_GOOD = frozenset("article content main body post entry story text".split())
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _hinted(attributes: str, inside: bool) -> bool:
    """Whether class, id or role say that an element, ``inside`` an article or not, is beside the text."""
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in _ROLES:
                return True
            continue
        for token in value.split():
            words = set(_SPLIT.split(token)) - {""}
            if words & {"comment", "comments", "sidebar", "advert", "ads", "cookie"}:
                return True
            if not words & _GOOD and (words & _STRONG or (words & _WEAK and (not inside or len(words) == 1))):
                return True
    return False


class Line(NamedTuple):
    text: str
    outside: int  # characters outside links
    around: tuple[int, ...]  # containers around it, from the outermost; the body isn't one
    articles: tuple[int, ...]  # those that are article or main elements
    marked: bool  # in an element beside the article
    region: int = 0  # outermost division, if it isn't around the whole page
    heading: bool = False


def lines(page: str) -> list[Line]:
    """The page's lines."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    outside, link, ids, at = 0, 0, 0, 0
    heading, divisions = False, set()

    def flush() -> None:
        nonlocal outside
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                around = tuple(i for name, i, _ in stack if name not in _TOP)
                articles = tuple(i for name, i, _ in stack if name in ("article", "main"))
                out.append(Line(text, outside, around, articles, any(m for *_, m in stack), heading=heading))
        outside = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if not link:
                outside += len(piece)
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1] and m[1].lower() in ("title", "textarea", "select", "button", "iframe", "object"):
                flush() if m[1].lower() == "title" else buffer.append(" ")
            continue
        closing = bool(m[2] or m[5])
        if name in _INLINE:
            if name == "a":
                link = 0 if closing else 1
            elif name in ("br", "wbr", "img", "input"):
                if name != "wbr":
                    buffer.append(" ")
            continue
        flush()
        link, heading = 0, not closing and name in ("h1", "h2", "h3")
        if name not in _CONTAINER and name not in _DROP:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and name in ("div", "section", "p", "ul", "ol"):
                    break
            continue
        attributes = m[4] or m[7] or ""
        if name in ("article", "main"):
            while stack and stack[-1][0] in ("nav", "header", "head", "menu", "ul", "ol") and any(n in _DROP for n, *_ in stack):
                stack.pop()
        if name == "body":
            while stack and stack[-1][0] == "head":
                stack.pop()
        inside = any(n in ("article", "main") for n, *_ in stack)
        marked = name in _DROP and not (name == "header" and inside)
        if not marked and attributes and name not in ("html", "body", "main"):
            marked = _hinted(attributes, inside) and not (name == "article" and "comment" not in attributes.lower())
        if attributes.rstrip().endswith("/"):
            continue
        ids += 1
        divisions |= {ids} if name in ("div", "section") else set()
        stack.append((name, ids, marked))
    if at < len(page):
        buffer.append(page[at:])
        outside += 0 if link else len(page) - at
    flush()
    whole = 0  # containers around all lines
    while out and all(len(line.around) > whole and line.around[whole] == out[0].around[whole] for line in out):
        whole += 1
    regions = [line.around[whole] if len(line.around) > whole and line.around[whole] in divisions else 0 for line in out]
    return [line._replace(region=r) for line, r in zip(out, regions)]


def blanks(a: Line, b: Line, marked: int, alone: set[int]) -> int:
    """Blank lines between two lines that have ``marked`` marked ones between them; ``alone``: regions of one line."""
    if a.articles != b.articles and not (a.articles and b.articles[: len(a.articles)] == a.articles):
        return GAP  # an article ends here, or begins outside any other
    if not a.articles and a.region and b.region and (a.region in alone) != (b.region in alone) and not a.heading:
        return GAP
    one = a.around == b.around
    shared = a.around if b.around[: len(a.around)] == a.around else b.around if a.around[: len(b.around)] == b.around else ()
    return (1 if one else 2) + (0 if shared or a.articles else min(marked, GAP))


def window_sums(weights: list[int], width: int) -> list[int]:
    """The sum over the ``width`` lines around each."""
    upto, half, n = [0, *accumulate(weights)], width // 2, len(weights)
    return [upto[min(n, i + width - half)] - upto[max(0, i - half)] for i in range(n)]


def stretch(found: list[Line], width: int, surge: float) -> tuple[int, int]:
    """First and end of the lines between the surge and the dive with the most text."""
    kept = [i for i, line in enumerate(found) if not line.marked]
    sizes = {i: len(found[i].text) if found[i].articles else found[i].outside for i in kept}
    if not any(sizes.values()):
        sizes = {i: len(found[i].text) for i in kept}
    alone = {r for r, n in Counter(found[i].region for i in kept).items() if n == 1}
    weights, spot = [], {}
    for k, i in enumerate(kept):
        if k:
            weights += [0] * blanks(found[kept[k - 1]], found[i], i - kept[k - 1] - 1, alone)
        spot[i] = len(weights)
        weights.append(sizes[i])
    sums = window_sums(weights, width)
    high = surge * max(sums, default=0)
    runs, begun, peak = [], None, 0  # between dives, if they surge
    for p, s in enumerate([*sums, 0]):
        if s:
            begun, peak = (p if begun is None else begun), max(peak, s)
        elif begun is not None:
            if peak >= high:
                runs.append((begun, p))
            begun, peak = None, 0
    best, at = (-1, 0, 0), 0
    for begun, end in runs:
        own = []
        while at < len(kept) and spot[kept[at]] < end:
            if spot[kept[at]] >= begun:
                own.append(kept[at])
            at += 1
        best = max(best, (sum(sizes[i] for i in own), -own[0], own[-1] + 1)) if own else best
    return -best[1], best[2]


def main_text(page: str | None, width: int = WIDTH, surge: float = SURGE) -> str:
    """The main text of one page."""
    found = lines(page) if page else []
    low, high = stretch(found, width, surge)
    if high <= low:
        return ""
    # The stretch has the lines that share the container of its heaviest one, if this isn't the page's outermost.
    own = [line for line in found[low:high] if not line.marked]
    home = max(own, key=lambda line: line.outside).around[-1:]
    if home and home != found[0].around[:1]:
        same = [i for i, line in enumerate(found) if home[0] in line.around and not line.marked]
        low, high = min(low, same[0]), max(high, same[-1] + 1)
    return "\n".join(line.text for line in found[low:high] if not line.marked)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x) for x in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_arrow(pages.select("page_id", "url", "html"), f, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
