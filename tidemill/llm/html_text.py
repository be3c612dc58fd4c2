"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of which nothing is text of the page.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "audio", "video"}
#: Elements that hold boilerplate.
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "button"}
#: Those that may also lie round a whole page, as a form of its server or by a forgotten end tag.
ROUND = {"nav", "form"}
#: Roles of the same kind.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words of class or id attributes that mark boilerplate.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Marks of things that are themselves made up of articles, so that an article in them stays marked.
CARDS = {"comment", "comments", "disqus", "reply", "replies", "respond", "related", "promo", "promotion", "sponsor", "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sidebar", "widget", "modal", "popup"}
#: Words by which a class tells the state of what it names, as in no-sidebar or share-enabled, and doesn't mark it.
STATES = {"no", "not", "non", "has", "have", "with", "without", "is", "enabled", "enable", "disabled", "disable", "on", "off", "left", "right", "open", "closed", "visible", "layout", "col", "cols", "columns", "one", "two", "three"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements within a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Open elements that a new one of these closes, as browsers do, looked for up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form"}
#: Containers of a page's main text.
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: What the logarithm of a ratio gains in a main container.
PRIOR = 3.0
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^a-z0-9]+")


def marks(names: str) -> set[str]:
    """Marks among the tokens of class and id attributes: whole tokens, or the first or last part of one without a state."""
    found = set()
    for token in names.lower().split():
        parts = [token] if token in MARKS else [p for p in _NAME.split(token) if p]
        if STATES.isdisjoint(parts):
            found |= MARKS & {parts[0], parts[-1]} if parts else set()
    return found


class Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, inside a main container, boilerplate, heading).

    Beside them, for each line, whether an element of ROUND alone makes it boilerplate, and whether most of it is links.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool, bool]] = []
        self.open: list[tuple[str, bool, float, bool]] = []  # tag, hidden, boilerplate (0 no, 1 by a layout word, 1.5 by ROUND, 2 surely), main
        self.about: list[tuple[bool, bool]] = []
        self.linked = 0  # characters of the line so far that are in links
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.text: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            _, _, aside, main = self.open[-1] if self.open else ("", False, 0, False)
            heading = any(tag in HEADINGS for tag, *_ in self.open[-3:])
            self.lines.append((line, max(1, self.tags), main, aside > 0, heading))
            self.about.append((aside == 1.5, 2 * self.linked > len(line)))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in CLOSES[tag]:
                    self.close_from(i)
                    break
                if self.open[i][0] in SCOPES:
                    break
        _, hidden, aside, main = self.open[-1] if self.open else ("", False, 0, False)
        held = dict(attrs)
        own = 1.5 if tag in ROUND else 2 if tag in ASIDE or (tag == "header" and not main) or (held.get("role") or "").lower() in ROLES else 0
        if own < 2 and tag not in {"html", "body", "article", "main"} and ("class" in held or "id" in held):
            # Ids of headings, and of sections in an article, are made from their titles; there a whole id may still be a mark.
            name = (held.get("id") or "").strip()
            named = "" if tag in HEADINGS or (main and name.lower() not in MARKS) else name
            if words := marks(f"{held.get('class') or ''} {named}"):
                own = max(own, 1 if CARDS.isdisjoint(words) else 2)
        if tag in MAIN and aside in (1, 1.5):
            aside = 0  # a wrapper named after a part of its layout
        hidden = hidden or tag in HIDDEN or "hidden" in held or (held.get("aria-hidden") or "").lower() == "true"
        self.open.append((tag, hidden, max(aside, own), main or (tag in MAIN and not aside)))
        self.count[tag] += 1

    def close_from(self, i: int) -> None:
        self.count.subtract(x[0] for x in self.open[i:])
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_from(i)
                break
            if tag in INLINE and self.open[i][0] not in INLINE:
                break

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def content_span(lines: list[tuple[str, int, bool, bool, bool]]) -> tuple[int, int] | None:
    """First and last line of the content; None if there is none.

    Ratios of characters to tags are smoothed along the page; the threshold is the best split of their
    logarithms into two clusters. A region runs from the first to the last line over it, so that short
    paragraphs between long ones stay, with headings right before it. Lines that markup names as boilerplate are never content. Where
    markup names a main container, its lines gain PRIOR and boilerplate, clustered with them, loses it.
    """
    usable = np.array([not x[3] for x in lines], bool)
    if not usable.any():
        return None
    main = np.array([x[2] for x in lines], bool) & usable
    led = bool(main.any())
    ratio = np.array([len(t) / n if led or not aside else 0.0 for t, n, _, aside, _ in lines])
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratio, 3), kernel / kernel.sum(), "valid")
    value = np.log1p(smooth) + (PRIOR * main - PRIOR * ~usable if led else 0.0)
    high = usable | led
    low, top = value[high].min(), value[high].max()
    if top - low > 0.5:
        for _ in range(20):
            cut = (low + top) / 2
            over, under = value[high & (value > cut)], value[high & (value <= cut)]
            new = (under.mean() if len(under) else low, over.mean() if len(over) else top)
            if new == (low, top):
                break
            low, top = new
        at = np.flatnonzero(usable & (value > (low + top) / 2))
        if not len(at):
            return None
        first = at[0]
        while first and usable[first - 1] and lines[first - 1][4]:
            first -= 1
        return int(first), int(at[-1])
    return 0, len(lines) - 1


def content_lines(lines: list[tuple[str, int, bool, bool, bool]]) -> list[str]:
    """The lines of the content that markup doesn't name as boilerplate."""
    span = content_span(lines)
    return [x[0] for x in lines[span[0] : span[1] + 1] if not x[3]] if span else []


def page_lines(lines: list[tuple[str, int, bool, bool, bool]], about: list[tuple[bool, bool]]) -> list[str]:
    """The content's lines of a whole page.

    A form or nav element that holds most of the page's text is no boilerplate. Short lines at the content's ends
    (of its main container, where there is one) belong to it up to the first that is links: a low ratio alone
    doesn't cut an article that nothing else follows. Without a main container links at the ends go.
    """
    sizes = [len(x[0]) for x in lines]
    if 2 * sum(n for n, (round_page, _) in zip(sizes, about, strict=True) if round_page) > sum(sizes):
        lines = [(*x[:3], x[3] and not round_page, x[4]) for x, (round_page, _) in zip(lines, about, strict=True)]
    span = content_span(lines)
    if span is None:
        return []
    led = any(x[2] and not x[3] for x in lines)
    own = [not x[3] and (x[2] or not led) and not links for x, (_, links) in zip(lines, about, strict=True)]
    first, last = span
    if not led:  # smoothing lifts links beside long lines
        while first < last and about[first][1]:
            first += 1
        while first < last and about[last][1]:
            last -= 1
    while first and own[first - 1]:
        first -= 1
    while last + 1 < len(lines) and own[last + 1]:
        last += 1
    return [x[0] for x in lines[first : last + 1] if not x[3]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    end = html.rfind(">") + 1  # no tag ends after it, so what follows is text, which the parser would try as a tag at each <
    for at in range(0, end, 1 << 16):  # events come as the text is fed
        parser.feed(html[at : min(at + (1 << 16), end)])
    parser.close()
    parser.handle_data(unescape(html[end:]))
    parser.cut()
    return " ".join(page_lines(parser.lines, parser.about))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        text = [main_text(h) for h in x.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    text is the main text of the whole html: character references decoded, white space inside a block made
    one space, blocks trimmed and joined in page order by one space. Null, empty and textless pages give ''.
    Parsing takes time in proportion to the page, also where tags are not closed or closed twice. A class word
    marks boilerplate only as a name, not as a state (no-sidebar), and not an article or main element within it.
    Repeated rows each give a row; ids and URLs may be null; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
