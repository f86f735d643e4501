from modgraph.llm.html_text import main_text

PROSE = "".join(f"<p>The {w} report was long, detailed, and full of facts, so readers stayed with it.</p>" for w in ("first", "second", "third", "fourth"))
SOURCES = '<ul><li><a href="/a">Source number one</a></li><li><a href="/b">Source number two</a></li></ul>'


def test_link_lists_and_small_parts_of_the_article_stay():
    page = f'<html><body><article><div class="entry-header"><h1>A title of its own</h1></div>{PROSE}{SOURCES}</article></body></html>'
    text = main_text(page)
    assert "A title of its own" in text and "Source number one" in text and "fourth report" in text


def test_link_lists_outside_the_article_go():
    page = f"<html><body>{SOURCES}<article>{PROSE}</article>{SOURCES}</body></html>"
    assert "Source" not in main_text(page)
