"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, each with its elements from the root. Elements that HTML itself names as no content
(menus, forms, scripts and the like, by tag, role or hidden) are set aside. The others' nodes are told apart by their
root-to-leaf path of block tags. Over each path the text outside of links and the punctuation are summed and divided by
its nodes; a node takes the two ratios of its path, they are smoothed along the page by a Gaussian and fused as a
geometric mean, and the mean of that over a path's nodes is its score. Paths at or above a threshold from the mean and
deviation of the scores, over all characters that no mark speaks against, are content; all else follows from their text:

* the root is the deepest element that holds SHARE of that text, or the ``article`` or ``main`` around it;
* words of classes and ids that speak of adverts, comments and the like are a weak prior: an element that has them goes
  only where the content outside of it is at least PRIOR of that inside, so they never take the bulk of a page's content
  away. Reader comments may be far longer than the article; they also go where OUTSIDE characters of content are left;
* lists of links and elements called sidebar and the like, up to half of the page, go where the root is no ``article``.

All other text of the root is given whole, so headings, short paragraphs, lists and tables stay.

Defined results: a null or empty page, or one without text, gives the empty string; white space is what Unicode calls
so; an unclosed element ends with the one around it; rows that repeat a page_id are pages of their own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
NEVER = frozenset("head nav footer aside form menu button select option dialog input fieldset".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that mark what is not the article; of the reader's comments; and of parts that
#: are small where they are not the article.
MARK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe breadcrumb breadcrumbs navbar menu pagination pager share sharing social related recommended recommendations".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
SMALL_WORDS = frozenset(
    "sidebar side nav navigation header masthead footer banner notice notices alert widget widgets toolbar login signup search copyright tags topbar aside".split()
)
WIDTH, SPREAD, SHARE, PRIOR, OUTSIDE = 2, 1.0, 0.8, 0.25, 50


class Element:
    __slots__ = ("tag", "parent", "off", "mark", "small", "size", "links", "content", "depth")

    def __init__(self, tag: str, parent: Element | None, off: bool = False, mark: str = "", small: bool = False):
        self.tag, self.parent, self.off, self.mark, self.small = tag, parent, off, mark, small
        self.size = self.links = self.content = 0
        self.depth = parent.depth + 1 if parent else 0


def kind_of(tag: str, attrs: str, inside: bool) -> tuple[bool, str, bool]:
    """Whether an element is never content, its mark ("", "part" or "comment"), and whether it is called like a small part."""
    off = tag in NEVER or tag == "header" and not inside
    mark, small = "", False
    if attrs and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                words = set(WORD.findall(value))
                if words & COMMENT_WORDS:
                    mark = "comment"
                elif words & MARK_WORDS:
                    mark = mark or "part"
                small = small or bool(words & SMALL_WORDS)
            elif name == "role":
                off = off or value in NEVER_ROLES
            elif name == "style":
                off = off or "display:none" in value.replace(" ", "")
            elif name == "hidden":
                off = True
            elif name == "aria-hidden":
                off = off or value == "true"
    return off, mark, small


def text_nodes(page: str) -> list[tuple[Element | None, str]]:
    """Text with its innermost element, in page order; (None, "") where a block begins or ends."""
    root = Element("#", None)
    top, out, at = root, [], 0
    articles = 0

    def text(raw: str) -> None:
        if raw:
            out.append((top, html.unescape(raw) if "&" in raw else raw))

    def close(until: Element) -> None:
        nonlocal top, articles
        while top is not until:
            articles -= top.tag in ("article", "main")
            top = top.parent

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag:
            tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
            if tag in ENDS_P or tag in CLOSES:
                wanted = CLOSES.get(tag, ("p",))
                e, last = top, None
                while e is not root and (e.tag in wanted or e.tag not in SCOPE):
                    if e.tag in wanted:
                        last = e
                    e = e.parent
                if last:
                    close(last.parent)
            if tag not in INLINE:
                out.append((None, ""))
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID:
                off, mark, small = kind_of(tag, attrs, articles > 0)
                top = Element(tag, top, top.off or off, mark, small)
                articles += tag in ("article", "main")
        elif m["end"]:
            tag = m["end"].lower()
            e = top
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                close(e.parent)
            if tag not in INLINE:
                out.append((None, ""))
        elif m["data"]:
            text(m["data"])
    text(page[at:])
    return out


def smoothed(values: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * (WIDTH / 2) ** 2)) for d in range(-WIDTH, WIDTH + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + WIDTH], values[i + d]) for d in range(-WIDTH, WIDTH + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def path_of(e: Element | None) -> tuple[tuple[str, ...], bool, bool]:
    """The block tags from the root, marked ones with an exclamation mark; whether any is marked, and whether in a link."""
    tags, marked, link = [], False, False
    while e:
        if e.tag not in INLINE:
            tags.append(e.tag + "!" * bool(e.mark))
        marked = marked or bool(e.mark)
        link = link or e.tag == "a"
        e = e.parent
    return tuple(reversed(tags)), marked, link


def content_nodes(nodes: list[tuple[Element, str]]) -> list[bool]:
    """Whether the path of each text node reaches the threshold."""
    known = {e: path_of(e) for e in {e for e, _ in nodes}}
    paths = [known[e][0] for e, _ in nodes]
    count, chars, marks = Counter(paths), Counter(), Counter()
    for p, (e, t) in zip(paths, nodes):
        if not known[e][2]:
            chars[p] += len(t.strip())
            marks[p] += len(PUNCTUATION.findall(t))
    length = smoothed([chars[p] / count[p] for p in paths])
    punctuation = smoothed([marks[p] / count[p] for p in paths])
    total: dict[tuple, float] = {}
    for p, a, b in zip(paths, length, punctuation):
        total[p] = total.get(p, 0.0) + math.sqrt(a * (b + 0.1))
    marked = {known[e][0] for e, _ in nodes if known[e][1]}
    scores = [total[p] / count[p] for p in paths]
    weights = [len(t.strip()) * (p not in marked) for p, (_, t) in zip(paths, nodes)]
    if not any(weights):
        weights = [len(t.strip()) for _, t in nodes]
    mean = sum(w * s for w, s in zip(weights, scores)) / sum(weights)
    deviation = math.sqrt(sum(w * (s - mean) ** 2 for w, s in zip(weights, scores)) / sum(weights))
    least = min(mean - SPREAD * deviation, max(scores)) - 1e-9  # equal scores all pass, however they were added up
    return [s >= least for s in scores]


def main_text(page: str | None) -> str:
    parts = text_nodes(page) if page else []
    nodes = [(e, t) for e, t in parts if e is not None and not e.off and t.strip()]
    if not nodes:
        return ""
    elements: dict[Element, None] = {}
    whole = content = 0
    chosen_nodes = content_nodes(nodes)
    for (e, t), chosen in zip(nodes, chosen_nodes):
        n, link, x = len(t.strip()), False, e
        whole += n
        content += n * chosen
        while x:
            elements[x] = None
            link = link or x.tag == "a"
            x.size += n
            x.links += n * link
            x.content += n * chosen
            x = x.parent
    # marked elements, outermost first: each is judged by the content that those before it left
    gone: set[Element] = set()
    left = content
    for e in sorted((e for e in elements if e.mark), key=lambda e: e.depth):
        x = e.parent
        while x and x not in gone:
            x = x.parent
        if x is None:
            outside = left - e.content
            if outside >= min(PRIOR * e.content, OUTSIDE if e.mark == "comment" else math.inf):
                gone.add(e)
                left = outside
    small = {
        e
        for e in elements
        if 2 * e.size <= whole and (e.small or e.tag in ("ul", "ol", "dl", "table") and e.links > 0.8 * e.size)
    }

    def below(e: Element | None, tops: set[Element]) -> bool:
        while e and e not in tops:
            e = e.parent
        return e is not None

    held: dict[Element, int] = {}
    for (e, t), chosen in zip(nodes, chosen_nodes):
        if chosen and not below(e, gone) and not below(e, small):
            x = e
            while x:
                held[x] = held.get(x, 0) + len(t.strip())
                x = x.parent
    if not held:
        held, small = {e: e.content for e in elements if e.content}, set()
    total = max(held.values())
    root = max((e for e in held if held[e] >= SHARE * total and e.tag not in INLINE and e.tag != "p"), key=lambda e: e.depth)
    around, x = [], root
    while x:
        if x.tag in ("article", "main"):
            around.append(x)
        x = x.parent
    root = next((x for x in around if x.tag == "article"), around[0] if around else root)
    tops = gone if root.tag == "article" else gone | small
    inside: dict[Element, bool] = {}

    def within(e: Element) -> bool:
        if e not in inside:
            x = e
            while x and x is not root:
                x = x.parent
            inside[e] = x is root and not e.off and not below(e, tops)
        return inside[e]

    return " ".join("".join(" " if e is None else t for e, t in parts if e is None or within(e)).split())


def _text_column(page: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in page.to_pylist()], pa.string())


def extract_text(page: str) -> Column:
    return F.arrow_udf(_text_column, "string")(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", extract_text("html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
