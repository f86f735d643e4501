import re

import duckdb
import pandas as pd
import pytest

from modgraph.llm import urls

SCHEMA = "page_id bigint, url string, html string, token string"
URLS = [
    "http://a.example.net/en/1?x",
    "http://EXAMPLE.net/de/",
    "https://Example.COM/de/x",
    "http://notexample.com/de/x",
    "http://x.org/fr/",
    "http://x.org/fr",
    "net/",
    "",
    None,
    "http://",
    "http://net/",
    "http://net",
    "http://user://x.net/",
    "http://Spam-Farm.example.org/a",
    "http://a.spam-farm.b.org",
    "http://notspam-farm.org",
    "http://x.org/banner/7/ad?k",
    "http://x.org/banner/7/admin",
    "http://casino.example.org/",
    "http://casino.example.com/",
    "http://x.org/wp-login.php",
    "http://x.org/a\nb?sessionid=3",
    "http://x.org/" + "a/" * 50_000,
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), f"{h}{p}", k) for k, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    hit = [p for p in urls.PATTERN_RULES if re.search(urls.pattern_regex(p), (url or "").lower())]
    return host, path, None, "block" if hit and not any(p.startswith("@@") for p in hit) else "allow"


@pytest.fixture(scope="module")
def rows():
    return [(i, u, "", "") for i, u in enumerate(URLS)] + [(3, URLS[3], None, None)]


def test_verdicts_match_brute_force_and_sql(spark, rows):
    got = urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html", "token"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.sql(urls.duckdb_sql()).fetchall()
    assert sorted(want, key=str) == sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str)


def test_tokens_are_mandatory():
    assert urls.pattern_tokens("||spam-farm.") == ["spam", "farm"]
    assert urls.pattern_tokens("/banner/*/ad^") == ["banner", "ad"]
    assert urls.pattern_tokens("swf") == []
    assert urls.pattern_tokens("a*b/c^") == ["c"]


def test_rules_without_tokens_see_every_url(spark):
    pages = spark.createDataFrame([(1, "http://x/aswfz", "", ""), (2, "http://x/b", "", "")], SCHEMA)
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, [], ["swf", "||y."]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rules_are_joined(spark, monkeypatch):
    from modgraph.llm import common

    pages = spark.createDataFrame([(i, f"http://a{i % 50}.example.com/x{i}/t{i}/", 0) for i in range(200)] + [(900, None, 0)], "page_id bigint, url string, token int")
    patterns = [f"||a{i}.example." for i in range(0, 50, 2)] + [f"/t{i}/" for i in range(1, 200, 3)] + ["@@/x4*", "x19", "@@x199"]
    want = {r.page_id: r.verdict for r in urls.judge_urls(pages, [], patterns).collect()}
    brute = lambda u: any(re.search(urls.pattern_regex(p), u) for p in patterns if p[:2] != "@@") and not any(re.search(urls.pattern_regex(p), u) for p in patterns if p[:2] == "@@")
    assert want == {i: "block" if brute(f"http://a{i % 50}.example.com/x{i}/t{i}/") else "allow" for i in range(200)} | {900: "allow"}
    monkeypatch.setattr(common.small_enough, "__defaults__", (0, 0))
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, [], patterns).collect()} == want
