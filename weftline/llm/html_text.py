"""Main text of web pages by line-block distribution.

Markup is stripped so that every block-level element starts a line. Over sliding windows of the lines their text lengths are summed:
text starts where the sum surges, and ends where it dives to nothing; what follows is text again only if it surges again, and everything
between such points is kept. Lines of links weigh nothing, and so does the edge of an article, so that what stands around one is a
block of its own.

Markup only says which lines are chrome (menus, adverts, footers, forms, ...) and don't enter the distribution: elements made for it,
and names that consist of chrome words as a whole. What holds the article, or nearly all of the text, isn't chrome by its name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import bounded_batches

#: Lines in a window; characters that a window needs to surge; share of link text that makes a shorter line outside an article a menu;
#: share of a page's text that no chrome holds by its name, where the page has no article.
WINDOW, SURGE, LINKS, MOST = 3, 80, 0.5, 0.8
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: Elements without a text of their own, whose content runs to their end tag.
_RAW = frozenset("script style noscript iframe template textarea title svg".split())
#: Elements that are chrome whatever they hold, and those that are unless they hold the article.
_CHROME, _MAYBE = frozenset("nav footer aside button select menu head option".split()), frozenset("form dialog fieldset header".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN, _HEADINGS = frozenset(("article", "main")), ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose end tag may be left out: what ends them, and what they are sought in.
_ENDED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDED.items()}
#: Words that a chrome name consists of, with those that only say where it stands or what holds it.
_NAMES = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies gdpr disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promos related recommended search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo login signup signin skip".split())
_PLACES = frozenset("site main top bottom left right primary secondary global box bar list item items block blocks area inner outer wrap wrapper container slot unit links link buttons button icons form posts news stories articles section group row col column panel overlay inline mobile desktop thread replies reply respond 1 2 3 4".split())
_REPLIES = frozenset("comment comments disqus".split())
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """A block of text, whether it stands in an article, the share of its text that is links, and whether it is a heading."""

    text: str
    inside: bool
    links: float
    heading: bool = False


class _Chrome:
    """An element that may be chrome: whether it is whatever it holds, whether it holds an article, its characters."""

    def __init__(self, sure: bool):
        self.sure, self.article, self.chars, self.closed = sure, False, 0, False


def _named(names: str) -> tuple[bool, bool]:
    """(whether one of these names consists of chrome words, whether it is one of readers' comments)."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _PLACES for w in words):
            return True, any(w in _REPLIES for w in words)
    return False, False


def _chrome(tag: str, attributes: str, inside: int) -> _Chrome | None:
    if tag in _CHROME:
        return _Chrome(True)
    if tag in _MAYBE and not (tag == "header" and inside):
        return _Chrome(False)
    if tag in ("html", "body", *_MAIN) and not (inside and tag == "article"):
        return None
    if not attributes or attributes.isspace():
        return None
    has = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attributes))}
    if ("hidden" in has and has["hidden"].lower() != "until-found") or re.search(r"display\s*:\s*none", has.get("style", ""), re.I):
        return _Chrome(False)
    chrome, replies = _named(f"{has.get('class', '')} {has.get('id', '')} {has.get('role', '')}")
    if chrome and not (inside and tag == "header"):
        return _Chrome(replies)
    return None


def lines(page: str) -> list[Line | None]:
    """The lines of a page that are not chrome; None where an article begins or ends."""
    out: list[tuple[Line | None, tuple[_Chrome, ...]]] = []
    parts: list[str] = []
    stack: list[tuple[str, _Chrome | None]] = []
    held: dict[str, int] = {}
    marks: list[_Chrome] = []
    linked, link, inside, at, some_article = 0, 0, 0, 0, False

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((Line(text, inside > 0, min(1.0, linked / len(text)), any(held.get(h) for h in _HEADINGS)), tuple(marks)))
            for m in marks:
                m.chars += len(text)
        parts.clear()
        linked = 0

    def pop(closed: bool) -> None:
        nonlocal inside
        tag, mark = stack.pop()
        held[tag] -= 1
        if mark:
            close()
            mark.closed = closed
            marks.remove(mark)
        if tag in _MAIN:
            inside -= 1
            if not inside:
                out.append((None, ()))

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        parts.append(text)
        if link:
            linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _BLOCKS:
            close()
        if tag == "a":
            link = 0 if ending else 1
        if tag in ("img", "input") and not ending:
            parts.append(" ")
        if ending:
            if held.get(tag):
                while stack[-1][0] != tag:
                    pop(True)
                pop(True)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCKS and held.get("p") and stack[-1][0] == "p":
            pop(True)
        if tag in _ENDED:
            ends, top = _ENDED[tag]
            for k in range(1, min(len(stack), 8) + 1):
                if stack[-k][0] in top:
                    break
                if stack[-k][0] in ends:
                    for _ in range(k):
                        pop(True)
                    break
        mark = _chrome(tag, attributes, inside)
        if tag in _BLOCKS or mark or held.get(tag):
            stack.append((tag, mark))
            held[tag] = held.get(tag, 0) + 1
        if mark:
            close()
            marks.append(mark)
        if tag in _MAIN:
            if not inside:
                out.append((None, ()))
            inside += 1
            for x in marks:
                x.article = True
            some_article = some_article or not any(x.sure for x in marks)
    close()
    while stack:
        pop(False)
    whole = sum(len(line.text) for line, own in out if line and not any(x.sure for x in own))
    gone = lambda x: x.sure or not (x.article or not x.closed or (not some_article and x.chars > MOST * whole))
    return [line for line, own in out if not any(map(gone, own))]


def _weights(found: list[Line | None]) -> list[int]:
    """Characters of each line; none at the edge of an article, and none of a short line of links outside one."""
    return [0 if x is None or (not x.inside and x.links >= LINKS and len(x.text) < SURGE) else len(x.text) for x in found]


def surge_and_dive(weight: list[int]) -> list[tuple[int, int | None, int]]:
    """(first line, line of the surge, line after the last) of each stretch of lines between two dives.

    A dive is a window of lines without weight, or the end. A stretch surges at its first line with weight that begins or ends a window
    of SURGE; there may be none.
    """
    runs: list[list[int]] = []
    for i in (i for i, n in enumerate(weight) if n):
        if not runs or i - runs[-1][-1] > WINDOW:
            runs.append([])
        runs[-1].append(i)
    out = []
    for own in runs:
        first, end = own[0], own[-1] + 1
        sums = lambda i, a=first, b=end: max(sum(weight[i : min(i + WINDOW, b)]), sum(weight[max(a, i + 1 - WINDOW) : i + 1]))
        out.append((first, next((i for i in own if sums(i) >= SURGE), None), end))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null, empty and textless pages.

    A stretch of lines between two dives is text if it stands in an article, or if it surges and holds as many characters as the page's
    articles together. A text outside an article begins at a heading that stands at most a window before its surge. Lines of links between two such stretches are text too. Where nothing is an article or surges, the lines with weight
    are the text; where none weighs anything, all lines are.
    """
    found: list[Line | None] = []
    for line in lines(page or ""):
        # an edge of an article is as wide as a window
        found += [None] * WINDOW if line is None else [line]
    weight = _weights(found)
    article = sum(n for x, n in zip(found, weight, strict=True) if x and x.inside)
    stretches = []
    for first, a, b in surge_and_dive(weight):
        inside, start = found[first].inside, first if a is None else a
        title = next((i for i in range(start - 1, max(first, start - WINDOW) - 1, -1) if found[i] and found[i].heading), start)
        stretches.append((first if inside else title, b, inside, a is not None))
    good = [inside or (surge and sum(weight[a:b]) >= article) for a, b, inside, surge in stretches]
    if not any(good):
        good = [True] * len(good)
    if not stretches:
        return " ".join(x.text for x in found if x)
    kept: list[Line | None] = []
    last = None
    for (a, b, inside, _), ok in zip(stretches, good, strict=True):
        if ok:
            # what links two texts outside an article is a part of them
            kept += found[last if last is not None and not inside else a : b]
        last = b if ok and not inside else None
    return " ".join(x.text for x in kept if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    A null or textless html gives an empty text; repeated rows are extracted as often as they come; other columns
    are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded_batches(pages).selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
