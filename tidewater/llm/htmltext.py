"""Main text of web pages by scores in the element tree.

A page becomes a light tree of elements and *blocks*: a block is the text between two
starts or ends of block elements. What is furniture by its tag, role or class is cut
with all that it holds. Every block that is left passes points for its length and its
commas to the containers around it, half as many at each step up, less the share of
its text that is links. The container with the most points, lifted to the article
around it, is kept with those of its siblings that score like it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values of HTML: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption head body html legend option optgroup tbody td tfoot th thead tr".split())
CELLS = frozenset("td th caption button object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: where one of these starts, an open element of the second kind ends, unless a wall is between
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dd", "dt"), ("dl",)),
    "dd": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "option": (("option",), ("select", "datalist")),
}

# fixed values of this extractor: what is furniture, and what holds an article
CUT_TAGS = frozenset(
    "head nav footer aside script style noscript template iframe noembed noframes svg canvas button select textarea"
    " object dialog menu search title audio video map xmp datalist".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos"
    " promotion sidebar sidebars side nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer"
    " comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert alerts banner"
    " banners popup popups modal modals overlay subscribe subscription newsletter signup login share sharing shares social"
    " related recommended recommendations pagination pager toolbar copyright disclaimer skip search form forms widget"
    " widgets paywall toc".split()
)
#: those that also describe the layout of what is around an article (``has-sidebar``)
LAYOUT_NAMES = frozenset(
    "ads sidebar sidebars side nav navbar navigation menu menus masthead footer cookie cookies notice banner search widget"
    " widgets toolbar toc skip share sharing social header".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text".split())
HOLDERS = frozenset(("article", "main"))
CONTAINERS = frozenset("article body center div form main section table tbody td".split())
PARAGRAPHS = frozenset("blockquote dl figure ol p pre table ul".split())
MENUS = frozenset("div dl ol section table ul".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: written in one word with others (``commentlist``, ``rightsidebar``); a commentary is no comment
_CUT_PARTS = re.compile(
    "advert|^ad(?:s|box|unit|slot|wrap|container|space)|breadcrumb|comment(?!ar)|cookie|disqus|footer|masthead|navbar"
    "|(?:top|main|side|sub|site|foot)nav|newsletter|paywall|popup|sidebar|sponsor|subscri(?:be|ption)|pagination|navigation"
)
_LAYOUT_PARTS = re.compile("sidebar|nav|footer|cookie")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMA = re.compile("[,،、，]")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}

#: how an element is treated: kept, cut, cut by its name only, by a name of layouts, a header, named as content
KEEP, CUT, CUT_BY_NAME, CUT_BY_LAYOUT, HEADER, GOOD = range(6)


@dataclass(frozen=True)
class Scoring:
    """Points of a block: one from ``long_block`` characters on, one for each ``per_chars``
    of them (``most_for_length`` at most), one for each comma. ``reach`` containers above
    it get them. ``holder_bonus`` goes to article and main elements, ``name_bonus`` to
    those named as content. Siblings with ``sibling_share`` of the best score are kept.
    Inside, a list of ``menu_links`` links or more with ``menu_density`` of its text in
    them is a menu.
    """

    reach: int = 4
    per_chars: int = 100
    most_for_length: float = 3.0
    long_block: int = 25
    holder_bonus: float = 25.0
    name_bonus: float = 10.0
    sibling_share: float = 0.2
    sibling_chars: int = 80
    sibling_links: float = 0.25
    menu_links: int = 3
    menu_density: float = 0.9


def _treatment(tag: str, attributes: str) -> int:
    if tag in CUT_TAGS:
        return CUT
    by_name, by_layout = False, tag == "form"
    header, good = tag == "header", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "class" or name == "id":
            words = {w.lower() for w in _NAME.findall(value)}
            names = {w for w in words if w in CUT_NAMES or _CUT_PARTS.search(w)}
            by_name = by_name or any(w not in LAYOUT_NAMES and not _LAYOUT_PARTS.search(w) for w in names)
            by_layout = by_layout or bool(names)
            header = header or "header" in words
            good = good or not words.isdisjoint(GOOD_NAMES)
        elif name == "role":
            by_name = by_name or value.lower() in CUT_ROLES
            good = good or value.lower() in HOLDERS
        elif name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return CUT
    return CUT_BY_NAME if by_name else CUT_BY_LAYOUT if by_layout else HEADER if header else GOOD if good else KEEP


class _Page:
    """Elements in page order (0 stands for the page) and the pieces of text of each block."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.kinds = ["body"], [-1], [KEEP]
        self.links: list[int] = []
        self.blocks: list[tuple[int, list[tuple[int, bool, str]]]] = []
        self._stack = [0]
        self._blocks = [0]  # places of block elements in the stack
        self._cells: list[int] = []  # and of cells, which end tags inside do not leave
        self._places: dict[str, list[int]] = {}
        self._pieces: list[tuple[int, bool, str]] = []
        self._read(html)

    def _flush(self) -> None:
        if self._pieces:
            self.blocks.append((self._stack[self._blocks[-1]], self._pieces))
            self._pieces = []

    def _close(self, depth: int) -> None:
        """Leave the elements from place ``depth`` of the stack on."""
        if self._blocks[-1] >= depth:
            self._flush()
        while len(self._stack) > depth:
            self._places[self.tags[self._stack.pop()]].pop()
        while self._blocks[-1] >= depth:
            self._blocks.pop()
        while self._cells and self._cells[-1] >= depth:
            self._cells.pop()

    def _last(self, *tags: str) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def _text(self, text: str) -> None:
        self._pieces.append((self._stack[-1], bool(self._places.get("a")), unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                break
            if lt > at:
                self._text(html[at:lt])
            found = _TAG.match(html, lt)
            if found is not None:
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                    at = found.end()
                else:
                    self._start(tag, found[3])
                    at = found.end()
                    if tag in RAW:
                        stop = _RAW_END[tag].search(html, at)
                        at = stop.end() if stop else end
            elif html.startswith("<!--", lt):
                stop = html.find("-->", lt + 2)
                at = end if stop < 0 else stop + 3
            elif html.startswith(("<!", "<?", "</"), lt) and not _TAG_START.match(html, lt):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif _TAG_START.match(html, lt):
                break  # the page ends inside a tag
            else:
                self._text("<")
                at = lt + 1
        self._flush()

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        elif place := self._places.get(tag):
            walled = self._cells and place[-1] < self._cells[-1] and tag not in CELLS and tag not in ("table", "tr", "tbody", "thead", "tfoot")
            if not walled and (tag in BLOCK or place[-1] > self._blocks[-1]):
                self._close(place[-1])
        elif tag in BLOCK:
            self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and self._last("p") > (self._cells[-1] if self._cells else -1):
            self._close(self._last("p"))
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if self._last(*ended) > self._last(*walls):
                self._close(self._last(*ended))
        elif tag in HEADINGS and self.tags[self._stack[-1]] in HEADINGS:
            self._close(len(self._stack) - 1)
        elif tag == "a" and self._last("a") > self._blocks[-1]:
            self._close(self._last("a"))
        if tag in BLOCK:
            self._flush()
        if tag in VOID or tag in RAW or tag == "html" or tag == "body":
            if tag == "br":
                self._text(" ")
            return
        here = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.kinds.append(_treatment(tag, attributes))
        if tag == "a":
            self.links.append(here)
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        if tag in CELLS:
            self._cells.append(len(self._stack))
        self._stack.append(here)


def _spread_up(page: _Page, values: list[int]) -> list[int]:
    """Sums over everything below each element."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += out[i]
    return out


def _cuts(page: _Page) -> list[bool]:
    """Which elements are furniture.

    A name cuts; but where all articles of the page are, or lie in, what names of layouts
    (``has-sidebar``) or a form cut, those do not. A form that holds most of the text is a
    wrapper too. If nothing else is left, articles are kept whatever their names. A header
    is cut but for headings in an article's own.
    """
    tags, parents, kinds = page.tags, page.parents, page.kinds
    n = len(tags)
    sizes = [0] * n
    for _, pieces in page.blocks:
        for element, _, text in pieces:
            sizes[element] += len(text)

    def spread(spared: list[bool]) -> list[bool]:
        cut, inside, header = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            above, kind, tag = parents[i], kinds[i], tags[i]
            inside[i] = inside[above] or tag in HOLDERS
            gone = kind == CUT or kind in (CUT_BY_NAME, CUT_BY_LAYOUT) and not spared[i]
            if kind == HEADER and not spared[i]:
                gone = gone or not inside[i]
                header[i] = True
            elif header[above] and tag not in HEADINGS:
                header[i] = True
            cut[i] = cut[above] or gone
        for i in range(1, n):
            cut[i] = cut[i] or header[i]  # headings in it are elements of their own
        return cut

    spared = [False] * n
    hard = [False] * n
    for i in range(1, n):
        hard[i] = hard[parents[i]] or kinds[i] in (CUT, CUT_BY_NAME)
    if "form" in tags:
        open_ = _spread_up(page, [0 if hard[i] else s for i, s in enumerate(sizes)])
        spared = [t == "form" and 2 * open_[i] > open_[0] for i, t in enumerate(tags)]
    cut = spread(spared)
    holders = [i for i in range(n) if tags[i] in HOLDERS]
    for spare in ([i for i in holders if not hard[i]], holders):
        if not spare or not all(cut[i] for i in holders) or spare is holders and any(s and not c for s, c in zip(sizes, cut)):
            continue
        for i in spare:
            while i > 0 and not spared[i]:
                spared[i] = True
                i = parents[i]
        cut = spread(spared)
    return cut


def main_blocks(html: str | None, rules: Scoring = Scoring()) -> list[str]:
    """The blocks of the main text of one page, in page order."""
    if not html:
        return []
    page = _Page(html)
    tags, parents = page.tags, page.parents
    n = len(tags)
    cut = _cuts(page)
    blocks: list[tuple[int, str, int]] = []
    for owner, pieces in page.blocks:
        text = " ".join("".join([t for e, _, t in pieces if not cut[e]]).split())
        if text:
            linked = len(" ".join("".join([t for e, link, t in pieces if link and not cut[e]]).split()))
            blocks.append((owner, text, min(linked, len(text))))
    if not blocks:
        return []

    points = [0.0] * n
    chars, linked = [0] * n, [0] * n
    for owner, text, link in blocks:
        chars[owner] += len(text)
        linked[owner] += link
        worth = min(len(text) / rules.per_chars, rules.most_for_length) + len(_COMMA.findall(text)) + (len(text) >= rules.long_block)
        worth *= 1 - link / len(text)
        step = 0
        while owner >= 0 and step < rules.reach:
            if tags[owner] in CONTAINERS:
                points[owner] += worth
                worth, step = worth / 2, step + 1
            owner = parents[owner]
    chars, linked = _spread_up(page, chars), _spread_up(page, linked)
    density = [b / a if a else 0.0 for a, b in zip(chars, linked)]

    def score(i: int) -> float:
        if not points[i]:
            return 0.0
        bonus = rules.holder_bonus * (tags[i] in HOLDERS) + rules.name_bonus * (page.kinds[i] == GOOD)
        return (points[i] + bonus) * (1 - density[i])

    scores = [score(i) for i in range(n)]
    best = max(range(n), key=lambda i: (scores[i], -i))
    for holder in ("article", "main"):
        above = best
        while above > 0 and tags[above] != holder:
            above = parents[above]
        if above > 0:
            best = above
            break

    kept = [False] * n
    kept[best] = True
    bare = -1  # an element whose own text is kept
    if best > 0:
        around = parents[best]
        least = rules.sibling_share * scores[best]
        ends = {}  # the last character of what a sibling holds
        for owner, text, _ in blocks:
            if parents[owner] == around:
                ends[owner] = text[-1]
        for i in range(1, n):
            if parents[i] != around or cut[i] or not chars[i]:
                continue
            if tags[i] in CONTAINERS:
                kept[i] = kept[i] or scores[i] > 0 and scores[i] >= least
            elif tags[i] in HEADINGS:
                kept[i] = around > 0 and density[i] < rules.sibling_links
            elif tags[i] in PARAGRAPHS:
                long = chars[i] > rules.sibling_chars
                kept[i] = density[i] < rules.sibling_links and (long or not linked[i] and ends.get(i) in (".", "!", "?", "。"))
        if around > 0 and tags[best] not in HOLDERS:
            bare = around
    links = [0] * n
    for i in page.links:
        links[i] = not cut[i]
    links = _spread_up(page, links)
    for i in range(1, n):
        if kept[parents[i]] and not kept[i]:
            menu = tags[i] in MENUS and links[i] >= rules.menu_links and density[i] >= rules.menu_density
            kept[i] = not menu
    return [t for o, t, link in blocks if kept[o] or o == bare and len(t) > rules.sibling_chars and link < rules.sibling_links * len(t)]


def extracted(pages: DataFrame, rules: Scoring = Scoring(), html: str = "html") -> DataFrame:
    """``pages`` without ``html``, in a struct ``row``, with ``text`` and ``n_chars`` next to it.

    Blocks are joined by one line break; inside a block white space is one space and
    character references are decoded. One narrow pass, whole pages, no shuffle. A null
    or empty page, and one that holds furniture only, has an empty text. A page without
    any tag is its own text. Repeated rows are extracted each for itself; other columns
    keep their names inside ``row``, whatever they are.
    """
    rest = [pages[f"`{c}`"] for c in pages.columns if c != html]
    packed = pages.select(
        pages[f"`{html}`"].cast("string").alias("html"),
        F.struct(*rest).alias("row") if rest else F.lit(None).cast("int").alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(x.as_py(), rules)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["row", "text", "n_chars"],
            )

    schema = StructType([packed.schema["row"], *StructType.fromDDL("text string, n_chars long").fields])
    return packed.mapInArrow(run, schema)
