"""Main text of web pages by line-block distribution (Chen, 2011).

Markup is stripped to lines, one per block of the page. A line's length counts only inside the page's
scope: its article or main element, else the smallest element that holds most of the page's text outside
boilerplate. Lengths are summed over sliding windows of WINDOW lines. The text begins at a surge, where a
window sum rises above the threshold and the next ones stay above zero, and ends at a dive, where the sums
fall to zero; all lines between are kept, short ones included. Lines of boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, comments) are known by tag, role, class and id, and belong to
no window.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW = 3
#: A surge needs a window sum above this many characters; shorter pages need their own largest sum.
SURGE = 80
#: A scope without an article holds at least this share of the page's text.
SCOPE_SHARE = 0.6

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that never show text of an article.
UNSEEN = frozenset("script style textarea title iframe noembed noframes head noscript template svg canvas audio video object map select datalist button dialog menu".split())
#: Elements of boilerplate by their meaning.
APART = frozenset("nav footer aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words in class and id that mark boilerplate.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsors sponsored promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login paywall "
    "menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets "
    "footer header masthead topbar toolbar banner banners search comment comments commentlist discussion disqus reply replies respond "
    "share sharing sharebar social follow related recommended recommendations trending outbrain taboola copyright".split()
)
#: Labels of parts that hold articles of others, which an article inside does not end.
FOREIGN = frozenset("comment comments commentlist discussion disqus reply replies respond related recommended recommendations trending sidebar sidebars aside".split())
#: Words before a label that deny it, as in "has-sidebar".
DENIAL = frozenset("has with no without".split())
#: Names of a header that is the article's own.
OWN = frozenset("article post entry story title page content".split())
#: Elements within a line; all others begin and end lines.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input "
    "picture source embed param track map area meta link".split()
)
#: Elements within a line that stand for white space.
SPACE = frozenset("br td th".split())
#: An open element that the next of its kind ends, and the elements that shield it.
IMPLIED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)


#: Elements that can be the scope of a page that names none.
CONTAINERS = frozenset("html body div section center table tbody tr td form".split())
#: Elements nested deeper than this are read as if they stood in the last one that is not, as browsers do.
MOST_DEEP = 512


@dataclass(slots=True)
class Element:
    """An open element: how it marks what is inside."""

    tag: str
    number: int
    parent: int
    unseen: bool = False
    apart: bool = False
    labelled: bool = False
    foreign: bool = False
    inside: bool = False


@dataclass(slots=True)
class Line:
    """Text of a block, the element it stands in, and what that element marks."""

    text: str
    element: int
    apart: bool
    labelled: bool
    heading: bool
    linked: int


@dataclass(slots=True)
class Page:
    """Lines of a page, tag and parent of every element, and the elements that call themselves its text."""

    lines: list[Line] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    articles: list[int] = field(default_factory=list)
    mains: list[int] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def labels(value: str) -> tuple[set[str], set[str]]:
    """Labels of boilerplate in a class or id, and all its words."""
    hit, every = set(), set()
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        every.update(parts)
        for before, part in zip(["", *parts], parts):
            if part in LABELS and before not in DENIAL:
                hit.add(part)
    return hit, every


def open_element(tag: str, source: str, above: Element, number: int) -> Element:
    """The element with what it inherits and what its tag, role, class and id say."""
    e = Element(tag, number, above.number, above.unseen, above.apart, above.labelled, above.foreign, above.inside)
    found = attributes(source) if source.strip() else {}
    hit, every = labels(f"{found.get('class', '')} {found.get('id', '')}")
    style = re.sub(r"\s", "", found.get("style", "")).lower()
    if tag in UNSEEN or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        e.unseen = True
    if tag in ("html", "body", "main"):
        e.labelled = e.labelled and tag != "main"
        e.apart = e.apart and tag != "main"
        return e
    if tag == "article":
        # An article ends menus and notices that were left open, not a list of comments or related articles.
        if not above.foreign:
            e.apart = e.labelled = False
        e.inside = not above.foreign
        e.labelled = e.labelled or bool(hit & FOREIGN) or bool(hit & {"ad", "ads", "advert", "promo", "sponsored"})
        e.foreign = e.foreign or bool(hit & FOREIGN)
        return e
    if tag in APART or found.get("role", "").lower() in ROLES or (tag == "header" and not above.inside):
        e.apart = True
        e.foreign = e.foreign or tag in ("footer", "aside")
    if above.inside or every & OWN:
        hit -= {"header"}
    e.labelled = e.labelled or bool(hit)
    e.foreign = e.foreign or bool(hit & FOREIGN)
    return e


def read_page(source: str) -> Page:
    """The lines of a page; a start tag without an end holds to the end of what is around it."""
    page = Page()
    stack = [Element("", 0, -1)]
    parts: list[str] = []
    linked = heading = anchors = 0

    def end_line() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            top = stack[-1]
            if text:
                page.lines.append(Line(text, block(), top.apart, top.labelled, bool(heading), min(linked, len(text))))
            parts.clear()
        linked = heading = 0

    def block() -> int:
        for e in reversed(stack):
            if e.tag not in INLINE:
                return e.number
        return 0

    def close(k: int) -> None:
        """End the open elements from place k of the stack on."""
        nonlocal anchors
        for e in stack[k:]:
            if e.tag == "a":
                anchors -= 1
        del stack[k:]

    def find(tag: str, shields: tuple[str, ...] = ()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                return k
            if stack[k].tag in shields:
                break
        return 0

    def say(text: str) -> None:
        nonlocal linked, heading
        if text and not stack[-1].unseen:
            parts.append(text)
            linked += len(text) if anchors else 0
            heading |= any(e.tag == "h1" for e in stack[-4:])

    at = 0
    while m := MARKUP.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        tag, rest, last = m[1] or m[3], m[2] or m[4] or "", m[5]
        if tag:
            tag = tag.lower()
            if tag in SPACE:
                say(" ")
            elif tag not in INLINE:
                end_line()
            if tag in ENDS_P and (k := find("p", ("article", "section", "div", "main", "td", "li", "blockquote", "body"))):
                close(k)
            if tag in IMPLIED and (k := find(tag, IMPLIED[tag])):
                close(k)
            if tag in VOID:
                continue
            number = len(page.parents)
            element = open_element(tag, rest, stack[-1], number)
            page.parents.append(element.parent)
            page.tags.append(tag)
            if tag == "article" and not element.labelled and not element.apart:
                page.articles.append(number)
            if tag == "main" or "articlebody" in rest.lower():
                page.mains.append(number)
            if rest.endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else len(source)
                continue
            if len(stack) < MOST_DEEP:
                stack.append(element)
                anchors += tag == "a"
        elif last:
            last = last.lower()
            if last in SPACE:
                say(" ")
            elif last not in INLINE:
                end_line()
            if k := find(last):
                close(k)
    say(source[at:])
    end_line()
    return page


def scope(page: Page, lines: list[Line]) -> tuple[set[int], bool]:
    """Elements in which lines count, and whether the page itself names them its text."""
    weight = [0] * len(page.parents)
    for line in lines:
        weight[line.element] += len(line.text) - line.linked
    plain = weight[:]
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parents[e]] += weight[e]
    for named in (page.articles, page.mains):
        held = [e for e in named if weight[e]]
        if held:
            best = max(held, key=lambda e: (weight[e], -e))
            break
    else:
        best, named = 0, []
        large = [e for e in range(1, len(weight)) if weight[0] and weight[e] >= SCOPE_SHARE * weight[0]]
        for e in large:
            # Large elements lie within each other. One with text of its own is the scope, wrappers around it are not.
            if plain[best] > (1 - SCOPE_SHARE) * weight[0] or page.tags[e] not in CONTAINERS:
                break
            best = e
    inside = {best}
    for e in range(best + 1, len(weight)):
        if page.parents[e] in inside:
            inside.add(e)
    return inside, bool(named)


def surge_to_dive(lengths: list[int], bonus: int) -> list[tuple[int, int]]:
    """Ranges of lines between a surge and the next dive; ``bonus`` is added to every line that counts."""
    padded = [n + bonus if n else 0 for n in lengths] + [0] * WINDOW
    sums = [sum(padded[i : i + WINDOW]) for i in range(len(lengths))] + [0]
    if not lengths or not (top := max(sums)):
        return []
    threshold, kept, i = min(SURGE, top - 1), [], 0
    while i < len(lengths):
        if not (sums[i] > threshold and padded[i]):
            i += 1
            continue
        begin = i
        while begin and padded[begin - 1]:
            begin -= 1
        while sums[i]:
            i += 1
        kept.append((begin, i))
    return kept


def main_text(source: str | None) -> str:
    """The main text of a page: blocks joined by an empty line; empty where there is none."""
    page = read_page(source or "")
    for lines in (
        [n for n in page.lines if not n.apart and not n.labelled],
        [n for n in page.lines if not n.apart],
        page.lines,
    ):
        if lines:
            break
    inside, named = scope(page, lines)
    first = next((i for i, n in enumerate(lines) if n.element in inside), 0)
    title = next((i for i, n in enumerate(lines[:first]) if n.heading and not named), None)
    lengths = []
    for i, n in enumerate(lines):
        counts = n.element in inside or i == title
        lengths.append(0 if not counts else len(n.text) if named or i == title or 2 * n.linked < len(n.text) else 0)
    kept = surge_to_dive(lengths, SURGE if named else 0)
    if not named and len(kept) > 1:
        # Regions of a page that does not name its text count if they hold a fair part of it.
        held = [sum(lengths[a:b]) for a, b in kept]
        kept = [r for r, n in zip(kept, held, strict=True) if 4 * n >= max(held) or (title is not None and r[0] <= title < r[1])]
    return "\n\n".join(n.text for a, b in kept for n in lines[a:b])


@F.pandas_udf(StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """The input's columns with ``text``, the main text of each page.

    Blocks are joined by two line feeds; character references are decoded; white space inside a block is
    one space. Null, empty and text-free pages give an empty text. Every row is judged by itself, whole and
    uncut: ties, repeated rows and null keys change nothing, an empty table gives an empty table, and an
    input column named ``text`` is replaced. A page is one unit of work.
    """
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "text"], main_texts(F.col(f"`{source}`")).alias("text"))


def page_lines(source: str) -> Iterator[tuple[str, bool]]:
    """Every line of a page and whether it is boilerplate, for a look at how a page is read."""
    return ((n.text, n.apart or n.labelled) for n in read_page(source).lines)
