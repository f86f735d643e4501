"""URL filters: host rules, and pattern rules behind an index of literal tokens.

A pattern rule is written like an ad blocker's: ``||name`` starts at a host label, ``^`` is a separator or the end, ``*``
is anything, ``@@`` in front makes an exception. Each rule becomes one regular expression and a list of mandatory
literal tokens (runs of letters and digits that separators delimit in the rule, hence in any URL that fits). Tokens are
counted over all URLs; each rule is indexed under its rarest token. A URL's tokens, of which only those that some rule
has are kept, fetch its candidate rules by a join with that index, broadcast after a check of its size and shuffled
beyond it, and only candidates run their expressions. Rules without a mandatory token are candidates everywhere, in one
pass for all of them.

Defined results: a null url, or one without "://", has an empty host and path, fits no host rule and is allowed;
a url's verdict depends on the url alone, so repeated rows agree; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import join_checked, materialize

#: Fixed values: (verdict, host, path) of the host rules.
HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: The pattern rules.
PATTERN_RULES = [
    "||spam-farm.",
    "||cheap-pills.",
    "||casino.",
    "||online-casino.",
    "||free-porn.",
    "||xxx.",
    "||adult.",
    "||warez.",
    "/banner/*/ad^",
    "/wp-login.php^",
    "/trackback/",
    "/cgi-bin/",
    "?sessionid=",
    "&sessionid=",
    "/cart/add^",
    "/calendar/*?month=",
    "@@||casino.example.org^",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern_regex(rule: str) -> str:
    """A regular expression that Java and RE2 read alike, for A-Z lower-cased URLs."""
    body = rule.removeprefix("@@").lower()
    start = ""
    if body.startswith("||"):
        start, body = r"^[^:/?#]*://([^/?#]*\.)?", body[2:]
    parts = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
    return start + "".join(parts.get(c, re.sub(r"([^a-z0-9/_%&=:-])", r"\\\1", c)) for c in body)


def pattern_tokens(rule: str) -> list[str]:
    """Literal tokens that every fitting URL has; a run at the rule's open end may go on in the URL and is none."""
    body = rule.removeprefix("@@").lower()
    anchored = body.startswith("||")
    body = body.removeprefix("||")
    found = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name, verdict = F.when(fits, f"{of}{start}").otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def pattern_hits(urls: DataFrame, patterns: list[str]) -> DataFrame:
    """(url, excepted) of the urls that a pattern rule fits."""
    spark = urls.sparkSession
    low = F.translate("url", UPPER, LOWER)
    known = urls.where("url is not null")
    vocabulary = sorted({t for p in patterns for t in pattern_tokens(p)})
    words = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    told = known.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    told = materialize(join_checked(told, words, "token", "inner"))  # the urls' tokens that some rule has
    counts = dict(told.groupBy("token").count().collect())  # at most as many as the rules' tokens
    index, everywhere = [], {False: [], True: []}
    for p in patterns:
        tokens = pattern_tokens(p)
        if tokens:
            index.append((min(tokens, key=lambda t: (counts.get(t, 0), t)), pattern_regex(p), p.startswith("@@")))
        else:
            everywhere[p.startswith("@@")].append(pattern_regex(p))
    rules = spark.createDataFrame(index, "token string, regex string, excepted boolean")
    fits = F.expr(f"translate(url, '{UPPER}', '{LOWER}') rlike regex")
    hits = join_checked(told, rules, "token", "inner").where(fits).select("url", "excepted")
    if any(everywhere.values()):  # one pass for all rules without a token
        any_of = {k: reduce(Column.__or__, (low.rlike(x) for x in v), F.lit(False)) for k, v in everywhere.items()}
        both = F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in any_of.items())))
        hits = hits.unionByName(known.select("url", F.explode(both).alias("excepted")))
    return hits.groupBy("url").agg(F.max("excepted").alias("excepted"))


def judge_urls(
    pages: DataFrame, host_rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[str] = PATTERN_RULES
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of pages (page_id, url)."""
    rows = pages.select("page_id", "url")
    hits = materialize(pattern_hits(rows, patterns))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    method = F.when(F.coalesce(~F.col("excepted"), F.lit(False)), "block").otherwise("allow")
    return join_checked(rows.withColumns({"host": host, "path": path}), hits, "url", "left").select(
        "page_id", "url", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )


def duckdb_sql(host_rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[str] = PATTERN_RULES) -> str:
    """The same judgement as DuckDB SQL, with every rule run on every url."""

    def any_of(rules: list[str]) -> str:
        return " or ".join(f"regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{pattern_regex(p)}')" for p in rules) or "false"

    def cases(column: int) -> str:
        longest = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
        value = lambda r: f"{r[1]}{r[2]}" if column else r[0]
        return " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value((k, h, p))}'" for k, h, p in longest)

    split = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
with parts as (
  select page_id, url, translate(coalesce(regexp_extract(url, {split}, 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, {split}, 2), '') as path,
    coalesce(({any_of([p for p in patterns if p[:2] != "@@"])}) and not ({any_of([p for p in patterns if p[:2] == "@@"])}), false) as hit
  from pages)
select page_id, host, path, case {cases(1)} end as rule,
  coalesce(case {cases(0)} end, case when hit then 'block' else 'allow' end) as verdict
from parts"""
