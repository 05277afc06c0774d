"""Main text of web pages by line-block distribution.

A page becomes lines: markup is stripped and every block-level tag ends a line. A line weighs as many characters as it
has outside links; where a page has an article or main element, lines in it weigh FACTOR times as much and their links
count once, and lines outside weigh nothing, as the head's lines do. Lines of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments (by element, class, id or role) weigh nothing and are never text.
The weights are summed over sliding windows of WINDOW lines. A text begins at a surge point, the first line that weighs
something where the sums rise from nothing, and ends at a dive point, the last such line before WINDOW lines together
weigh nothing. It is kept, with the weightless lines within it, if a window of it reaches the surge: SURGE, or half of
the page's largest window where that is less.

Null or empty html: empty text. Null ids and urls stay, repeated rows each give a row, other columns are not read.
Pages cut off within a tag lose that tag only. Very long pages are read whole, a slice of pages at a time, in time linear
in their length however deep elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import slices

WINDOW, FACTOR = 3, 8
#: What a window must weigh, at most, to be a surge.
SURGE = 86
_ATTRIBUTES = r"""(?:[^"'<>]|"[^"<]*+"|'[^'<]*+')*+>"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|iframe|xmp)\b[^>]*+(?:>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>{_ATTRIBUTES}|[^>]*+(?:>|\Z))|<[/!?][^>]*+(?:>|\Z)",
    re.I | re.S,
)
#: Elements that end a line, hold others, and hold no main text.
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol option p pre section select summary svg table tbody td template tfoot th thead title tr ul video".split())
HOLDERS = set("a address article aside blockquote body button center dd details dialog div dl dt fieldset figure footer form head header hgroup li main menu nav noscript ol p section select span svg table tbody td template tfoot th thead title tr ul".split())
CLUTTER = set("aside button dialog fieldset footer form menu nav noscript select svg template".split())
CLUTTER_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|notice|popup|modal|overlay|comments?|disqus|respond|reply|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Elements that are text themselves are clutter by these names only.
TEXT_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookies?|comments?|newsletter|breadcrumbs?)(?:$|[\s_-])", re.I)
TEXTS = set("a dd dt li p span td th".split())
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LINKED = re.compile(r"(?:^|\s)href\s*=", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SIBLINGS = {"li": {"ul", "ol", "menu"}, "p": set(), "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "dd": {"dl"}, "dt": {"dl"}}


def is_clutter(name: str, attrs: str, in_article: bool) -> bool:
    if name in CLUTTER or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main") or not attrs:
        return False
    names = TEXT_NAME if name in TEXTS else CLUTTER_NAME
    return any(names.search(m.strip("\"'")) for m in NAMED.findall(attrs)) or HIDDEN.search(attrs) is not None


@dataclass(frozen=True, slots=True)
class Line:
    """text; plain: characters outside links; clutter: of a menu or the like; article: in an article or main element; head: of the page's head."""

    text: str
    plain: int
    clutter: bool
    article: bool
    head: bool


@dataclass(frozen=True, slots=True)
class Holder:
    """An open element, with what holds for the text in it."""

    name: str
    clutter: bool = False
    article: bool = False
    head: bool = False
    link: bool = False

    def same(self, other: Holder) -> bool:
        return (self.clutter, self.article, self.head) == (other.clutter, other.article, other.head)


def closed_links(tokens: list[re.Match]) -> set[int]:
    """Places in tokens of the links that end before the next one begins."""
    out, ends = set(), False
    for k in range(len(tokens) - 1, -1, -1):
        if (tokens[k]["name"] or "").lower() == "a":
            if tokens[k]["end"]:
                ends = True
            else:
                if ends and LINKED.search(tokens[k]["attrs"]):
                    out.add(k)
                ends = False
    return out


def lines(page: str) -> list[Line]:
    out: list[Line] = []
    outside = Holder("")
    stack, depth = [outside], Counter()
    text: list[str] = []
    plain = at = 0
    tokens = list(TOKEN.finditer(page))
    linked = closed_links(tokens)

    def flush() -> None:
        nonlocal plain
        if text:
            if joined := " ".join(html.unescape("".join(text)).split()):
                top = stack[-1]
                out.append(Line(joined, min(plain, len(joined)), top.clutter, top.article, top.head))
            text.clear()
        plain = 0

    for k, m in enumerate(tokens):
        if m.start() > at:
            text.append(piece := page[at : m.start()])
            plain += 0 if stack[-1].link else len(piece.strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if name not in HOLDERS:
            continue
        if m["end"]:
            if not depth[name]:  # nothing to end
                continue
            place = len(stack) - 1
            while stack[place].name != name:
                place -= 1
            if not stack[-1].same(stack[place - 1]):
                flush()
            for gone in stack[place:]:
                depth[gone.name] -= 1
            del stack[place:]
        elif not m["attrs"].endswith("/>"):
            if name == "body" or stack[-1].head and name not in ("title", "noscript", "template"):
                del stack[1:]
                depth.clear()
            elif name in SIBLINGS and stack[-1].name == name:
                depth[name] -= 1
                stack.pop()
            above = stack[-1]
            inside = above.article or name in ("article", "main")
            own = Holder(name, above.clutter or is_clutter(name, m["attrs"][:-1], above.article), inside, above.head or name in ("head", "title"), above.link or k in linked)
            if not own.same(above):
                flush()
            stack.append(own)
            depth[name] += 1
    if at < len(page):
        text.append(page[at:])
        plain += 0 if stack[-1].link else len(page[at:].strip())
    flush()
    return out


def weights(found: list[Line]) -> np.ndarray:
    marked = any(x.article and not x.clutter for x in found)

    def weight(x: Line) -> int:
        if x.clutter or x.head or marked and not x.article:
            return 0
        return FACTOR * x.plain + len(x.text) - x.plain if marked else x.plain

    return np.array([weight(x) for x in found], np.int64)


def stretches(weight: np.ndarray) -> list[tuple[int, int]]:
    """First and last line of each text: from surge point to dive point."""
    if not weight.any():
        return []
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))  # sums[i]: lines i - WINDOW + 1 to i
    least = min(SURGE, sums.max() / 2)
    high = np.concatenate(([False], sums > 0, [False]))
    rise, fall = np.flatnonzero(high[1:] & ~high[:-1]), np.flatnonzero(high[:-1] & ~high[1:])
    # a rise begins with a line that weighs something; the fall comes WINDOW - 1 sums after the last one
    return [(a, b - WINDOW) for a, b in zip(rise.tolist(), fall.tolist(), strict=True) if sums[a:b].max() >= least]


def main_text(page: str | None) -> str:
    """The texts between surge and dive points, a block a line."""
    found = lines(page or "")
    return "\n".join(x.text for a, b in stretches(weights(found)) for x in found[a : b + 1] if not x.clutter)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string")
