"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path.  Text length and punctuation are
aggregated per path, smoothed along the page, fused by multiplication and
thresholded at their standard deviation: the nodes of paths above it are
content.  The article is the smallest element that holds most of the content
found, widened to the ``article`` or ``main`` element around it; its blocks are
returned in page order, without furniture.

Furniture is an element by its tag or role, or by a class or id made of nothing
but words for furniture and for containers.  A name that has such a word among
others (``legal-analysis``) only raises the question, which the paths answer:
it is furniture unless most of its text is on content paths.  An element that
holds most of the content found isn't furniture, whatever its tag or name,
unless it is beside an ``article`` or ``main`` with content.

Elements are numbered as they open, so those inside one are a range of numbers
and every sum over an element is a difference of two running sums; paths are
numbers too.  Time and memory grow with the page alone, however deep it nests.

Defined results: null or empty html, or a page without text: empty string.
Unclosed and stray tags, and pages cut off anywhere, are read as browsers
would close them.  Repeated rows are extracted each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^<>]*)(?:>|(?=<)|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg select object canvas annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What a head may hold; anything else begins the body.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE = frozenset("nav footer aside form fieldset dialog menu head button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement"
    " advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login signin form search share sharing social related recommended recommendations comment"
    " comments disqus discussion reply replies respond responses widget toolbar pagination pager skip copyright legal disclaimer"
    " notification notifications announcement announcements teaser teasers trending outbrain taboola paywall".split()
)
#: Name parts that say nothing of what is in an element.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button center col column container content cta group header holder inline inner item items large left link links list"
    " main module more outer page pane panel post posts primary right row secondary section site small sticky top unit wide wrap wrapper js is m l u c".split()
)
#: Furniture by how a name part begins or ends, for names written together.
NAMED_BEFORE = ("comment", "sidebar", "advert", "cookie", "breadcrumb", "newsletter", "sponsor", "navbar", "navigation", "footer")
NAMED_BEHIND = ("menu", "navbar", "sidebar", "footer", "subnav", "topnav", "sitenav", "mainnav", "comments", "banner")
HEADER = frozenset(["header", "topbar"])
#: A name part before which the furniture is only spoken of.
ABOUT = frozenset("has with no without".split())
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
#: Share of all content that the article's element must hold.
MOST = 0.8


class Element:
    """One element of the page: only what the extraction needs."""

    __slots__ = ("parent", "name", "path", "index", "last", "out", "listed", "asked", "header", "heading", "inside")

    def __init__(self, parent: Element | None, name: str, path: int, index: int, out: bool, listed: bool, asked: bool, header: bool):
        self.parent, self.name, self.path = parent, name, path
        #: Its number, and that of the last element inside it.
        self.index = self.last = index
        self.out = out or bool(parent and parent.out)
        #: Furniture by tag or name, itself alone; ``asked``: perhaps.
        self.listed, self.asked = listed, asked
        self.header = header or bool(parent and parent.header)
        self.inside = name in ("article", "main") or bool(parent and parent.inside)
        #: In a heading within the article.
        self.heading = name in HEADINGS or bool(parent and parent.heading and name not in ("article", "main"))


class Page:
    """What is open while a page is read, and what was found."""

    def __init__(self, names: bool):
        self.names, self.elements, self.paths, self.open = names, [], {}, Counter()
        self.here = self._add(None, "", "", False, False, False, False)
        #: Blocks in page order, each the text nodes of it.
        self.blocks: list[list[tuple[Element, str]]] = []

    def _add(self, parent: Element | None, name: str, label: str, *kinds: bool) -> Element:
        path = self.paths.setdefault((parent.path if parent else -1, label), len(self.paths))
        element = Element(parent, name, path, len(self.elements), *kinds)
        self.elements.append(element)
        return element

    def enter(self, name: str, rest: str) -> None:
        label, out, listed, asked, header = name, False, name in FURNITURE, False, name == "header"
        if rest and not rest.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
            kinds = [found.get("class", ""), found.get("id", "")]
            label = f"{name}.{kinds[0]}" if kinds[0] else name
            out = "hidden" in found or found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true"
            out = out or "display:none" in found.get("style", "").replace(" ", "").lower()
            if self.names and name not in ("html", "body", "main") and name not in HEADINGS:
                for kind in " ".join(kinds).split():
                    sure, perhaps, head = _named(kind)
                    listed, asked, header = listed or sure, asked or perhaps, header or head
        self.here = self._add(self.here, name, label, out, listed, asked, header)
        self.open[name] += 1

    def close(self, element: Element) -> None:
        last = len(self.elements) - 1
        while self.here is not element.parent:
            self.here.last = last
            self.open[self.here.name] -= 1
            self.here = self.here.parent

    def end(self) -> None:
        while self.here is not None:
            self.here.last = len(self.elements) - 1
            self.here = self.here.parent


@lru_cache(maxsize=4096)
def _named(kind: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names furniture, names it among other things, or names a header."""
    parts = [p.lower() for p in PART.findall(kind)]
    some, other, header = False, False, False
    for i, p in enumerate(parts):
        header = header or p in HEADER or p.endswith("header")
        if i and parts[i - 1] in ABOUT:
            continue
        if p in NAMES or p.startswith(NAMED_BEFORE) or p.endswith(NAMED_BEHIND):
            some = True
        elif p not in NEUTRAL and not p.isdigit():
            other = True
    return some and not other, some and other, header


def parse(html: str, names: bool = True) -> Page:
    """The page's elements, and its blocks with the text nodes of each."""
    page = Page(names)
    parts: list[tuple[Element, str]] = []
    low: str | None = None

    def end_block() -> None:
        nonlocal parts
        if parts:
            page.blocks.append(parts)
            parts = []

    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            if page.here.name == "head" and not html[at:mark].isspace():
                page.close(page.here)
            parts.append((page.here, html[at:mark]))
        if mark == size:
            break
        tag = TAG.match(html, mark)
        if tag is None:
            parts.append((page.here, "<"))
            at = mark + 1
            continue
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if name is None:
            if tag[0].startswith("<![CDATA["):
                parts.append((page.here, tag[0][9:].removesuffix("]]>")))
            continue
        name, ends, rest = name.lower(), tag["end"] or tag["end2"], tag["rest"] or tag["rest2"] or ""
        if ends:
            # Only where one is open: a stray end doesn't walk the page.
            if page.open[name]:
                walk = page.here
                while walk.name != name:
                    walk = walk.parent
                if name in BLOCK:
                    end_block()
                page.close(walk)
            continue
        if page.here.name == "head" and name not in IN_HEAD:
            page.close(page.here)
        if name == "br":
            parts.append((page.here, " "))
            continue
        if name in RAW:
            if low is None:
                low = html.lower()
                if len(low) != size:  # a few letters grow when lowered
                    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), html)
            to = low.find(f"</{name}", at)
            at = size if to < 0 else (html.find(">", to) + 1 or size)
            continue
        if name in BLOCK:
            end_block()
            # A block ends the paragraph it would stand in.
            if page.open["p"]:
                walk = page.here
                while walk.parent is not None and walk.name not in BLOCK:
                    walk = walk.parent
                if walk.name == "p":
                    page.close(walk)
        if name in CLOSES and any(page.open[n] for n in CLOSES[name][0]):
            these, stop = CLOSES[name]
            walk = page.here
            while walk.parent is not None and walk.name not in stop:
                if walk.name in these:
                    page.close(walk)
                    break
                walk = walk.parent
        if name in VOID:
            continue
        if not rest.endswith("/") or name in BLOCK:
            page.enter(name, rest)
    end_block()
    page.end()
    return page


class Sums:
    """Sums over elements of what their text nodes carry."""

    def __init__(self, page: Page, nodes: list[tuple[Element, str]], values: np.ndarray):
        own = np.zeros(len(page.elements))
        np.add.at(own, [e.index for e, _ in nodes], values)
        self.running = np.r_[0, np.cumsum(own)]

    def of(self, element: Element) -> float:
        return float(self.running[element.last + 1] - self.running[element.index])


def _unwanted(page: Page, nodes: list[tuple[Element, str]]) -> list[bool]:
    """Of every element whether it is in furniture."""
    wrong = [False] * len(page.elements)
    freed: set[Element] = set()
    doubtful: set[Element] = set()
    if nodes and any(e.listed or e.asked for e in page.elements):
        size = np.array([len(t.strip()) for _, t in nodes], float)
        fused, chosen = path_scores([e.path for e, _ in nodes], size, _marks(nodes))
        score = fused * size * chosen
        weight, text, content = Sums(page, nodes, score), Sums(page, nodes, size), Sums(page, nodes, size * chosen)
        # Elements of which none is in furniture by tag or name, to tell whether an article is left.
        sure = [False] * len(page.elements)
        for e in page.elements:
            sure[e.index] = e.listed or e.asked or bool(e.parent and sure[e.parent.index])
        article = any(take and e.inside and not sure[e.index] for (e, _), take in zip(nodes, chosen.tolist(), strict=True))
        for e in page.elements:
            if (e.listed or e.asked) and weight.of(e) >= MOST * score.sum() and (e.inside or not article):
                freed.add(e)
            if e.asked and not e.listed and 2 * content.of(e) >= text.of(e) > 0:
                doubtful.add(e)
    for e in page.elements:
        own = (e.listed or e.asked and e not in doubtful) and e not in freed
        wrong[e.index] = e.out or own or bool(e.parent and wrong[e.parent.index])
    for e in page.elements:
        if e.header and not (e.heading and e.inside):
            wrong[e.index] = True
    return wrong


def _marks(nodes: list[tuple[Element, str]]) -> np.ndarray:
    return np.array([len(PUNCTUATION.findall(t)) for _, t in nodes], float)


def path_scores(paths: list[int], lengths: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fused score of every text node and whether its path is content."""
    _, of = np.unique(np.array(paths), return_inverse=True)
    count = np.bincount(of)
    ratio = (np.bincount(of, lengths) / count)[of]
    punctuation = (np.bincount(of, marks) / count)[of]
    weight = np.convolve(np.ones(len(of)), KERNEL, "same")[: len(of)] if len(of) >= len(KERNEL) else None

    def smooth(x: np.ndarray) -> np.ndarray:
        return x if weight is None else np.convolve(x, KERNEL, "same") / weight

    fused = smooth(ratio) * (1 + smooth(punctuation))
    by_path = np.bincount(of, fused) / count
    return fused, (by_path >= min(fused.std(), by_path.max()))[of]


def _region(page: Page, nodes: list[tuple[Element, str]], score: np.ndarray, chosen: np.ndarray) -> Element:
    """The smallest element that holds most of the chosen nodes' score, widened."""
    weight = Sums(page, nodes, score * chosen)
    most = MOST * weight.running[-1]
    # Those that hold so much lie inside one another, so the last to open is the smallest.
    region = max((e for e in page.elements if weight.of(e) >= most), key=lambda e: e.index)
    while region.name not in BLOCK and region.parent is not None:
        region = region.parent
    outer: Element | None = None
    walk: Element | None = region
    while walk is not None:
        if walk.name == "article" or walk.name == "main" and outer is None:
            outer = walk
        walk = walk.parent
    if outer is not None:
        return outer
    # Without article or main: widen while what is added is headings or content.
    content = {e for (e, _), take in zip(nodes, chosen.tolist(), strict=True) if take}
    other = [e not in content and e.name not in HEADINGS and not (e.parent and e.parent.name in HEADINGS) for e, _ in nodes]
    others = Sums(page, nodes, np.array(other, float))
    while region.parent is not None and region.parent.parent is not None and others.of(region.parent) == others.of(region):
        region = region.parent
    return region


def extract(html: str | None) -> str:
    """Main text of a page: blocks joined by an empty line."""
    if not html:
        return ""
    for names in (True, False):
        page = parse(html, names)
        blocks = [[(e, unescape(t)) for e, t in parts if not e.out] for parts in page.blocks]
        wrong = _unwanted(page, [(e, t) for parts in blocks for e, t in parts if t and not t.isspace()])
        blocks = [[(e, t) for e, t in parts if not wrong[e.index]] for parts in blocks]
        nodes = [(e, t) for parts in blocks for e, t in parts if t and not t.isspace()]
        if nodes:
            break
    else:
        return ""
    size = np.array([len(t.strip()) for _, t in nodes], float)
    fused, chosen = path_scores([e.path for e, _ in nodes], size, _marks(nodes))
    region = _region(page, nodes, fused * size, chosen)
    texts = ("".join(t for e, t in parts if region.index <= e.index <= region.last) for parts in blocks)
    return "\n\n".join(text for text in (" ".join(t.split()) for t in texts) if text)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    source = pages.select("page_id", "url", "html")
    schema = StructType([source.schema["page_id"], source.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(kernel, schema)
