"""HTML extraction by line-block distribution: surges and dives of text length over windows of lines.

Every line of the page counts, the menus and footers, too: its length is its characters outside links, times the weight of
the elements around it. Weights are all that elements and class words decide; windows over the weighted lengths
decide what is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.shared import column

#: A comment, a declaration, or a tag whose quoted attribute values may hold '>'. A quote that never ends holds nothing: such a tag ends at its first '>'.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Words of a name: runs of letters, cut where a capital begins another word.
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Parts of a name that turn the next into its opposite, as in "no-sidebar".
_NOT = frozenset("no not non without hide hidden".split())
#: Weight of a character in an article or main element; of one in an element that a class word marks; in one that by its name holds no article.
IN_MAIN, MARKED, OUTSIDE = 25.0, 2.0**-16, 0.0
#: Elements whose content is never text of the page: their end tag is searched for as it stands.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp select".split())
#: Elements that hold anything but the article.
ASIDE = frozenset("nav header footer aside form dialog menu button fieldset".split())
#: Words of class, id and role that mark the same.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent contentinfo copyright disclaimer disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related replies reply respond response responses share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold the article where a page has them.
MAIN = frozenset(("article", "main"))
#: Elements that end unsaid where one of these begins.
_P_ENDS = BLOCK - frozenset("body br caption col dd dt figcaption head html legend li option summary tbody td tfoot th thead tr".split())
_CELLS = frozenset("td th tr tbody tfoot thead".split())
IMPLIED = {"p": _P_ENDS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "td": _CELLS, "th": _CELLS, "tr": _CELLS - {"td", "th"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that last until an end tag: their own or that of an element around them.
HOLDS = BLOCK - VOID - frozenset(IMPLIED)


def _weight(name: str, attributes: str) -> float:
    """What an element multiplies its text's weight with: OUTSIDE or MARKED where it is set aside, else 1."""
    if name in ASIDE:
        return OUTSIDE
    if name in ("html", "body", *MAIN) and "comment" not in attributes.lower():
        return 1.0
    for groups in _NAMED.findall(attributes):
        for word in "".join(groups).split():
            parts = [part.lower() for part in _NAME_PART.findall(word)]
            if any(p in ASIDE_WORDS and (k == 0 or parts[k - 1] not in _NOT) for k, p in enumerate(parts)):
                return MARKED
    return 1.0


class _Open:
    """The open elements, outermost first; each is a number. Ending one ends those inside it."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.count: Counter = Counter()
        self.last = 0

    def __bool__(self) -> bool:
        return bool(self.stack)

    def has(self, name: str) -> bool:
        return self.count[name] > 0

    def open(self, name: str) -> None:
        self.last += 1
        self.stack.append((name, self.last))
        self.count[name] += 1

    def close(self, name: str) -> None:
        while self.count[name]:
            top, _ = self.stack.pop()
            self.count[top] -= 1
            if top == name:
                break

    def block(self) -> int:
        return self.stack[-1][1] if self.stack and self.stack[-1][0] not in ("html", "body") else 0


#: A line of a page: its text, its length outside links, the weight of its characters, and the block around it (0: the page or its body).
Line = tuple[str, int, float, int]


def lines_of(page: str) -> list[Line]:
    """All lines of a page but for those of raw elements.

    An element that is set aside ends with its end tag, where it is implied (the next paragraph or item, say), or with an
    element around it. In article and main elements links count as text.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, inside = False, 0
    skip, low = "", 1.0  # the element that is set aside, and its weight
    within, around = _Open(), _Open()  # what is open inside it, and outside
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                free = len(text) - (0 if inside else len(" ".join(html.unescape("".join(linked)).split())))
                lines.append((text, max(0, free), (IN_MAIN if inside else 1.0) * (low if skip else 1.0), -1 if skip else around.block()))
            parts.clear()
            linked.clear()

    while at < end:
        tag = _MARKUP.search(page, at)
        upto = tag.start() if tag else end
        if upto > at:
            parts.append(page[at:upto])
            if in_link:
                linked.append(page[at:upto])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = bool(tag[1])
        if skip:
            if name in BLOCK or name == skip:
                close()
            if closing:
                if within.has(name):
                    within.close(name)
                    continue
                if name == skip and not (name in IMPLIED and within):
                    skip = ""
                    continue
                if not around.has(name):
                    continue
            elif within or name not in IMPLIED.get(skip, ()):
                if name in RAW:
                    at = _after(page, name, at)
                elif name in HOLDS or (name == skip and name not in IMPLIED):
                    within.open(name)
                continue
            close()
            skip = ""  # its end is implied by this tag, which counts
        if name in RAW:
            if not closing and not tag[3].rstrip().endswith("/"):
                at = _after(page, name, at)
            continue
        if not closing and name not in VOID and (weight := _weight(name, tag[3])) < 1:
            close()
            skip, low, within = name, weight, _Open()
            continue
        if name in BLOCK:
            close()
            if name in MAIN:
                inside = max(0, inside + (-1 if closing else 1))
            if name in HOLDS:
                around.close(name) if closing else around.open(name)
        elif name == "a":
            in_link = not closing
    close()
    return lines


def _after(page: str, name: str, at: int) -> int:
    stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
    return stop.end() if stop else len(page)


def main_text(page: str | None, window: int = 3, rise: float = 25, least_share: float = 0.0) -> str:
    """The lines between surges and dives of the windowed text length, joined by line feeds.

    The length at a line is that of its window of lines: each line's characters outside links, times its weight. Weights
    are taken by the highest that any text of the page has: where there is an article element, all around it weighs next to
    nothing, and where all text is marked by class words, it has the full weight. A surge is where the length reaches
    `rise` (or an eighth of the page's highest, if that is less); the dive that ends a stretch is a window without weight.
    A line of next to no weight dives by itself. Neighbours that are parted by such lines alone, or that end and begin in
    one block, or stand in article elements, are one stretch in parts. All stretches are kept; with `least_share` only those
    that have that share of the longest one's length.
    """
    lines = _weighed(lines_of(page)) if page else []
    size = [free * weight for _, free, weight, _ in lines]
    block = [sum(size[k : k + window]) for k in range(len(size))]
    if not any(block):
        return ""
    over = min(rise, max(block) / 8)
    little = over / 64
    stretches, k = [], 0  # lists of parts (first line, line after the last)
    while k < len(block):
        if block[k] < over and not (block[k] > little and k + window >= len(block)):
            k += 1
            continue
        last = k
        while last < len(block) and block[last] > little:
            last += 1
        low = k
        while size[low] <= little and low + 1 < last:  # the window reaches the text before the line does
            low += 1
        if stretches and _joined(lines, stretches[-1][-1][1], low):
            stretches[-1].append((low, last))
        else:
            stretches.append([(low, last)])
        k = last
    share = [sum(size[k] for low, high in parts for k in range(low, high) if not _light(lines[k])) for parts in stretches]
    longest = max(share, default=0)
    return "\n".join(lines[k][0] for parts, s in zip(stretches, share) if s >= least_share * longest for low, high in parts for k in range(low, high) if not _light(lines[k]))


def _weighed(lines: list[Line]) -> list[Line]:
    """The lines with weights by the highest of any text: the others' fall by as much as class words take."""
    top = max((weight for _, free, weight, _ in lines if free), default=0.0)
    if not top:
        return lines
    return [(text, free, IN_MAIN if weight == top == IN_MAIN else 1.0 if weight == top else weight / top * (MARKED if top == IN_MAIN else 1.0), block) for text, free, weight, block in lines]


def _light(line: Line) -> bool:
    return line[2] < 1.0


def _joined(lines: list[Line], after: int, before: int) -> bool:
    """Whether the lines from `after` to `before` are all light, or the texts on their two sides stand in one block or in articles."""
    while after and _light(lines[after - 1]):
        after -= 1
    if all(_light(line) for line in lines[after:before]):
        return True
    return bool(after) and (lines[after - 1][3] == lines[before][3] != 0 or lines[after - 1][2] == lines[before][2] == IN_MAIN)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The pages' other columns with the main text of the whole html and its code points; one row each, no shuffle.

    Null and empty html, and a page of nothing but boilerplate, give the empty text and 0. Unclosed and stray tags,
    cut pages and pages of any length are read to their end. Columns of the new names are replaced.
    """
    kept = [f for f in pages.schema if f.name not in (text_col, count_col, html_col)]
    source = pages.select(*[pages[f.name] for f in kept], pages[html_col].cast("string").alias("_page"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in column(batch, "_page")]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *added], names=[*(f.name for f in kept), text_col, count_col])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType()), T.StructField(count_col, T.LongType())]))
