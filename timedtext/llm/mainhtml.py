"""Main text of web pages by line-block distribution.

Markup is stripped to a sequence of lines, one for each block of text. A line weighs as much as it has text outside links;
names of tags and classes only change weights: lines of menus, footers, sidebars, notices, adverts, forms and readers'
comments weigh nothing, lines in a part marked as ``article`` or ``main`` a hundred times as much, in an article within a
main part three times that. Where such a part begins or ends, empty lines stand, as in a page's source.

Sums of the weights over a sliding window of lines rise from zero at a surge point and are back at zero at a dive point;
what lies between is a region. The heaviest region is of the article, and so are the regions of the same element (an
advert or an inline menu may cut an article in parts) and, on pages that mark no part, regions of a quarter of its mass.
Lines of those regions are kept but for the boilerplate among them; nothing is dropped for being short or for its links.

Classes and ids count as boilerplate by their whole name only: one of the words below, perhaps with words of place before
it and words of structure behind it (``cookie-banner``, ``left-sidebar``), so ``related-work``, ``has-sidebar`` and
``search-results`` are no boilerplate.

Defined results: a null or empty page, and one without text, gives an empty text. Unclosed, crossed or truncated tags are
read as browsers do in the main: unknown end tags are ignored, and the end of the page closes what is open. Time is linear
in the length of the page, whatever its tags. Of regions of equal mass the first counts. Repeated rows each get a row.
Extra columns are left as they are; a column named like a new one is replaced.
"""

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose content is no text at all.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "math", "xmp", "noembed", "noframes", "audio", "video", "map", "title"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for t in RAW}
#: Elements that hold boilerplate whatever their class.
SIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head", "label", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Blocks that hold other blocks; the others are part of the text around them.
HOLDERS = {"article", "aside", "body", "center", "details", "dialog", "div", "footer", "form", "header", "html", "main", "nav", "section"}
#: Blocks that end where one of their kind begins.
ITEMS = {"li", "dd", "dt", "option", "tr", "td", "th"}
CONTAINERS = {"article", "main"}
_PLACES = r"(?:(?:site|page|main|top|bottom|global|left|right|primary|secondary|sticky|fixed|inline|block|widget|js)[_-])*"
_STRUCTURE = r"(?:[_-]?(?:slot|unit|box|banner|bar|container|wrapper|wrap|block|area|section|list|inner|outer|holder|content|text|top|bottom|left|right|links|items?|panel|group|row|zone|frame|form|message|modal|popup|notice|widget|menu|wide|\d+))*"
#: Names of boilerplate wherever they stand, and such as an article may use for its own parts.
ALWAYS = r"ads?|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|comments?|commentlist|disqus|replies|respond|sidebar|navbar|navigation|breadcrumbs?|pagination|pager|share|sharing|social|outbrain|taboola|sr-only|skip-link"
OUTSIDE = r"banner|notice|notification|alert|side|widget|menu|nav|header|masthead|topbar|toolbar|footer|related|recommended|more-stories|skip|copyright|legal|login|search|hidden|tags"
NAMED = re.compile(rf"{_PLACES}(?:{ALWAYS}|{OUTSIDE}){_STRUCTURE}", re.I)
NAMED_INSIDE = re.compile(rf"{_PLACES}(?:{ALWAYS}){_STRUCTURE}", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Lines in a window.
WINDOW = 3
#: A line with more of its text in links than this is a list of links.
LINKED = 0.67
#: What text counts outside and in a marked part, and in an article within a main part.
PLAIN, MARKED, NESTED = 1, 100, 300
#: On a page without marked parts, the part of the heaviest region's mass from which another one belongs to the article.
ALSO = 0.25
SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    weight: int
    #: Boilerplate, wherever it stands.
    side: bool
    #: The marked part it lies in (0: none) and the element it belongs to.
    container: int
    home: int


GAP = [Line("", 0, True, 0, 0)] * WINDOW


def _is_side(tag: str, attributes: str, inside: bool) -> bool:
    if tag in SIDE or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            named = NAMED_INSIDE if inside else NAMED
            if any(named.fullmatch(x) for x in value.split()):
                return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Open(NamedTuple):
    """An open element, and what held before it."""

    tag: str
    side: bool
    container: int
    links: int
    home: int


class _Reader:
    """Lines of a page, tag by tag. ``at`` has the places of each open tag on the stack, so no tag is searched for."""

    def __init__(self):
        self.lines: list[Line] = []
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.side, self.container, self.links, self.home = False, 0, 0, 0
        self.made = 0
        self.nested: set[int] = set()
        self.pages = {0}
        self.parts: list[str] = []
        self.all = self.linked = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)
            n = len(raw.strip())
            self.all += n
            if self.links:
                self.linked += n

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                headline = bool(self.blocks) and self.stack[self.blocks[-1]].tag == "h1"
                link = self.linked > LINKED * self.all and not self.container and not headline
                factor = NESTED if self.container in self.nested else MARKED if self.container else PLAIN
                own = self.stack[self.blocks[-1]] if self.blocks else None
                # a div with text in it belongs to the element around it, unless that is the whole page
                home = own.home if own and own.tag == "div" and own.home not in self.pages else self.home
                self.lines.append(Line(text, 0 if self.side or link else len(text) * factor, self.side, self.container, home))
            self.parts.clear()
        self.all = self.linked = 0

    def close(self, k: int) -> None:
        """Close the elements from place k of the stack on."""
        left = self.stack[k]
        if left.container != self.container:
            self.lines += GAP
        for x in reversed(self.stack[k:]):
            self.at[x.tag].pop()
        del self.stack[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        _, self.side, self.container, self.links, self.home = left

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        places = self.at.get(tag)
        if places:
            k = places[-1]
            # an inline element does not close the blocks within it
            if tag in BLOCK or not self.blocks or self.blocks[-1] < k:
                self.close(k)
            elif tag == "a":
                self.links = self.stack[k].links

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            # an open paragraph ends where a block begins, an open item where the next one does
            while self.stack and (self.stack[-1].tag == "p" or self.stack[-1].tag == tag and tag in ITEMS):
                self.close(len(self.stack) - 1)
            if tag == "p" and self.at["p"] and self.blocks[-1] == self.at["p"][-1]:
                self.close(self.at["p"][-1])
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        self.at[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(_Open(tag, self.side, self.container, self.links, self.home))
        self.made += 1
        if tag in HOLDERS:
            self.home = self.made
            if tag in ("html", "body"):
                self.pages.add(self.made)
        if not self.side and _is_side(tag, attributes, bool(self.container)):
            self.side = True
        elif tag in CONTAINERS and not self.side:
            inner = tag == "article" and self.container and self.container not in self.nested and self.at["main"]
            if inner or not self.container:
                self.lines += GAP
                self.container = self.made
                if inner:
                    self.nested.add(self.container)
        if tag == "a":
            self.links += 1


def lines_of(page: str) -> list[Line]:
    reader = _Reader()
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            reader.text(page[at:])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            if tag in BLOCK:
                reader.flush()
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag == "br" or tag == "wbr":
            reader.parts.append(" " if tag == "br" else "")
        else:
            reader.start(tag, m[3])
    reader.flush()
    return reader.lines


def surges(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Regions [surge, dive): from where the sum over the next ``window`` lines rises above zero to where the sum over the last ones is zero again."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    out, start, last = [], None, -1
    for i, w in enumerate(weights):
        if w and start is None:
            start = i
        if start is not None and sums[i + 1] - sums[max(0, i + 1 - window)] == 0:
            out.append((start, last + 1))
            start = None
        if w:
            last = i
    if start is not None:
        out.append((start, last + 1))
    return out


def article(lines: list[Line]) -> list[tuple[int, int]]:
    """The regions of the article: the heaviest one and those that belong to it."""
    regions = surges([x.weight for x in lines])
    if not regions:
        return []
    # a marked part is one thing, whatever cuts it; elsewhere each region stands for itself
    mass: dict = defaultdict(int)
    part = {}
    for a, b in regions:
        first = lines[a].container
        part[a] = first or -1 - a
        mass[part[a]] += sum(x.weight for x in lines[a:b])
    best = max(mass, key=lambda p: (mass[p], -abs(p)))
    if best > 0:
        return [r for r in regions if part[r[0]] == best]
    top = -1 - best
    homes = {x.home for x in lines[top : next(b for a, b in regions if a == top)] if x.weight}
    of_it = lambda a, b: mass[part[a]] >= ALSO * mass[best] or any(x.home in homes for x in lines[a:b] if x.weight)
    return [(a, b) for a, b in regions if part[a] < 0 and of_it(a, b)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    return "\n\n".join(x.text for a, b in article(lines) for x in lines[a:b] if x.text and not x.side)


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page and its length in code points."""

    @F.pandas_udf("string")
    def taken(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([main_text(x) for x in p], dtype=object)

    return pages.withColumn(out, taken(page)).withColumn("n_chars", F.length(out).cast("long"))
