"""A second, plain implementation of the extraction's definition over well-formed pages, and cases where scores decide."""

import math
import random
import re
from html.parser import HTMLParser

import pytest

from modgraph.llm import html_text
from modgraph.llm.html_text import main_text

INLINE = {"a", "em", "b"}
OFF = {"nav", "form", "footer"}
LONG = "A first sentence, with words. A second one; longer, too. "


class Tree(HTMLParser):
    """Nodes as dicts: tag, words, kids (nodes and strings), up."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = self.at = {"tag": "#", "words": set(), "kids": [], "up": None}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "words": set(re.findall("[a-z]+", dict(attrs).get("class", ""))), "kids": [], "up": self.at}
        self.at["kids"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def ups(node):
    while node:
        yield node
        node = node["up"]


def second(page):
    texts, order, inside = [], [], 0

    def walk(node, off):
        nonlocal inside
        off = off or node["tag"] in OFF or node["tag"] == "header" and not inside
        node["off"] = off
        node["mark"] = "comment" if node["words"] & html_text.COMMENT_WORDS else "part" if node["words"] & html_text.MARK_WORDS else ""
        order.append(node)
        inside += node["tag"] in ("article", "main")
        for kid in node["kids"]:
            if isinstance(kid, str):
                if kid.strip() and not off:
                    texts.append((node, kid.strip()))
            else:
                walk(kid, off)
        inside -= node["tag"] in ("article", "main")

    walk(Tree(page).top, False)
    if not texts:
        return ""
    path = lambda n: "/".join(x["tag"] + "!" * bool(x["mark"]) for x in reversed(list(ups(n))) if x["tag"] not in INLINE)
    linked = lambda n: any(x["tag"] == "a" for x in ups(n))
    of = {}
    for i, (n, _) in enumerate(texts):
        of.setdefault(path(n), []).append(i)
    ratio = [[0.0, 0.0] for _ in texts]
    for members in of.values():
        plain = [texts[i] for i in members if not linked(texts[i][0])]
        a, b = (sum(f(t) for _, t in plain) / len(members) for f in (len, lambda t: len(re.findall(r"[.,;:!?…。，、；：！？]", t))))
        for i in members:
            ratio[i] = [a, b]
    fused = []
    for i in range(len(texts)):
        near = [(math.exp(-2 * d * d / html_text.WIDTH**2), i + d) for d in range(-html_text.WIDTH, html_text.WIDTH + 1) if 0 <= i + d < len(texts)]
        a, b = (sum(w * ratio[j][k] for w, j in near) / sum(w for w, _ in near) for k in (0, 1))
        fused.append(math.sqrt(a * (b + 0.1)))
    score = [0.0] * len(texts)
    for members in of.values():
        for i in members:
            score[i] = sum(fused[j] for j in members) / len(members)
    free = [not any(x["mark"] for x in ups(n)) for n, _ in texts]
    every = [s for s, (_, t), f in zip(score, texts, free) for _ in t if f or not any(free)]  # a character each
    mean = sum(every) / len(every)
    least = min(mean - html_text.SPREAD * math.sqrt(sum((x - mean) ** 2 for x in every) / len(every)), max(score)) - 1e-9
    good = [s >= least for s in score]
    size = lambda node, test: sum(len(t) for i, (n, t) in enumerate(texts) if test(i, n) and any(x is node for x in ups(n)))
    whole = sum(len(t) for _, t in texts)
    left, gone = sum(len(t) for (_, t), g in zip(texts, good) if g), []
    for node in sorted((n for n in order if n["mark"] and not n["off"]), key=lambda n: len(list(ups(n)))):
        if not any(x is g for x in ups(node["up"]) for g in gone) and size(node, lambda i, n: True):
            own = size(node, lambda i, n: good[i])
            if left - own >= html_text.PRIOR * own or node["mark"] == "comment" and left - own >= html_text.OUTSIDE:
                gone.append(node)
                left -= own
    small = []
    for node in order:
        n = size(node, lambda i, n: True)
        if n and 2 * n <= whole and (node["words"] & html_text.SMALL_WORDS or node["tag"] in ("ul", "table") and size(node, lambda i, n: linked(n)) > 0.8 * n):
            small.append(node)
    under = lambda n, tops: any(x is t for x in ups(n) for t in tops)
    test = lambda i, n: good[i] and not under(n, gone) and not under(n, small)
    held = [(node, size(node, test)) for node in order if size(node, test)]
    if not held:
        small, held = [], [(node, size(node, lambda i, n: good[i])) for node in order if size(node, lambda i, n: good[i])]
    most = max(h for _, h in held)
    deep = [node for node, h in held if h >= 0.8 * most and node["tag"] not in INLINE | {"p"}]
    root = max(deep, key=lambda n: len(list(ups(n))))
    named = [x for x in ups(root) if x["tag"] == "article"] or [x for x in ups(root) if x["tag"] == "main"]
    root = named[0] if named else root
    tops = gone if root["tag"] == "article" else gone + small
    out = []

    def write(node, on):
        on = on or node is root
        block = node["tag"] not in INLINE
        out.append(" " * block)
        for kid in node["kids"]:
            if isinstance(kid, str):
                if on and not node["off"] and not under(node, tops):
                    out.append(kid)
            else:
                write(kid, on)
        out.append(" " * block)

    write(Tree.__new__(Tree) and order[0], False)
    return " ".join("".join(out).split())


def random_page(rng):
    classes = ["", "", "", "wrap", "ad", "post related-topic", "comments", "sidebar", "page ads-enabled", "entry-header", "x1"]

    def text():
        return rng.choice(["Home", "Read more", "x", "Two words, here.", LONG, LONG * 3, "No stop at all in this rather long line of words"])

    def node(depth):
        tag = rng.choice(["div", "div", "section", "article", "p", "ul", "nav", "main", "footer", "form", "h2", "header"])
        c = rng.choice(classes)
        attrs = f' class="{c}"' if c else ""
        if tag in ("p", "h2"):
            return f"<{tag}{attrs}>{text()}{rng.choice(['', '<em>it</em>', '<a>link text</a>', '<b>bold, too.</b> end'])}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{rng.choice(['<a>' + text() + '</a>', text()])}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        return f"<{tag}{attrs}>" + "".join(node(depth + 1) if depth < 4 else text() for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    return "<html><body>" + "".join(node(0) for _ in range(rng.randint(1, 4))) + "</body></html>"


@pytest.mark.parametrize("seed", range(10))
def test_second_implementation_agrees(seed):
    rng = random.Random(seed)
    for _ in range(40):
        page = random_page(rng)
        assert main_text(page) == second(page), page


PROSE = f"<p>{LONG}</p>" * 4
MENU = "<div class=x1><div>Home</div><div>Sports</div><div>Weather today</div></div>"


def test_scores_decide(monkeypatch):
    page = f"<body>{MENU * 6}<div class=x2><h2>Head</h2><p>{LONG * 2}</p><p>{LONG * 2}</p></div>{MENU}</body>"
    want = " ".join(["Head", *[LONG.strip()] * 4])
    assert main_text(page) == want
    monkeypatch.setattr(html_text, "content_nodes", lambda nodes: [True] * len(nodes))
    assert main_text(page) != want


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="page ads-enabled"><nav>Menu</nav><article>{PROSE}</article></div></body>',
        f'<body><div>Home / News</div><article class="post related-topic">{PROSE}</article></body>',
        f'<body><article id="share">{PROSE}</article></body>',
        f'<body><article class="comments-open">{PROSE}</article></body>',
    ],
)
def test_marks_never_take_the_article(page):
    assert main_text(page) == " ".join([LONG.strip()] * 4)


def test_parts_of_the_article_stay():
    page = f'<article><p class="byline">By Ann</p>{PROSE}<section class="legal"><p>Printed by us.</p></section><p>So <math><mi>x</mi></math> is.</p><ul><li><a href=/>Source</a></li></ul></article>'
    text = main_text(page)
    assert text.startswith("By Ann") and text.endswith("Printed by us. So x is. Source")


def test_two_articles_stay():
    assert main_text(f"<main><article><p>{LONG}</p></article><article><p>{LONG * 2}</p></article></main>") == " ".join([LONG.strip()] * 3)
