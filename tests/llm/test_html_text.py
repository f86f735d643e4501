import pytest

from modgraph.llm.html_text import extract_pages, main_text, smoothed, text_nodes

LONG = "A first sentence, with words. A second one; longer, too. "
PAGES = {
    "article": (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<!-- ad --><div class='ad'>Buy.</div><article><h1>Title &amp;&quot;x&quot;</h1><p><b>{LONG}<br><p>Two\n\t words</p></article><footer>&copy; x</footer>",
        f'Title &"x" {LONG.strip()} Two words',
    ),
    "divs": (
        f"<body class='has-sidebar'><header><h1>Site</h1></header><div id=menu><a href=a>A</a></div><div class=wrap><div class=content><h2>Head</h2><p>{LONG}</p>"
        f"<p>More <em>te</em>xt, yes.</p><div class='share buttons'>Share!</div></div><aside><p>{LONG}</p></aside></div><div id=comments><p>{LONG * 9}</p></div></body>",
        f"Head {LONG.strip()} More text, yes.",
    ),
    "comment articles": (
        f"<main><article><p>{LONG}</p></article><section class='comments'><article class='comment'><p>{LONG * 5}</p></article></section></main>",
        LONG.strip(),
    ),
    "form": (f"<main><form><label>Mail</label><input value='a>b'></form><p>{LONG}</p><div role='alert'>Note</div></main>", LONG.strip()),
    "fragment": ("<p>1 &lt; 2 and 3 < 4 &nbsp;x<p>y", "1 < 2 and 3 < 4 x y"),
    "plain": ("only text\n here", "only text here"),
    "broken": ("<div title='x>un<closed <p>a</b></i>b</div", "ab"),
    "empty": ("", ""),
    "null": (None, ""),
    "none": ("<div><script>x</script></div>", ""),
    "unclosed script": ("<p>a</p><script>b<p>c", "a"),
    "entities": ("<p>&am &amp &#233;&#x41;&unknown;</p>", "&am & éA&unknown;"),
    "header in article": (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title {LONG.strip()}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    if name == "broken":
        assert main_text(page).endswith("ab")
    else:
        assert main_text(page) == want


def test_long_and_deep_pages():
    many = "".join(f"<p>{LONG}</p>" for _ in range(20_000))
    assert main_text(f"<article>{many}</article>") == " ".join([LONG.strip()] * 20_000)
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG.strip()
    assert main_text("<" * 100_000 + "a") == "<" * 99_999 or main_text("<" * 100_000) == "<" * 100_000


def test_smoothing_keeps_constants():
    assert all(abs(x - 3) < 1e-12 for x in smoothed([3.0] * 7))
    assert smoothed([]) == []


def test_nodes_know_their_elements():
    nodes = [(e.tag, t) for e, t in text_nodes("<ul><li>a<li>b</ul>c") if e]
    assert nodes == [("li", "a"), ("li", "b"), ("#", "c")]


def test_query_form(spark):
    schema = "page_id bigint, url string, html string, text int"
    rows = [(i, f"u{i}", PAGES[k][0], 1) for i, k in enumerate(PAGES)] + [(0, None, PAGES["article"][0], 1)]
    got = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if list(PAGES)[r.page_id] != "broken":
            assert r.text == PAGES[list(PAGES)[r.page_id]][1]
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
