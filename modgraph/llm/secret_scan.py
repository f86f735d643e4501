"""Secret scans behind an inverted index of trigrams.

Every rule's regular expression yields a Boolean query of lower-case trigrams that any match must contain: literals give
conjunctions, alternatives disjunctions. The index is a table of postings (term, key): which texts, by their hash, have
which trigram of the rules' vocabulary. Intersecting the postings of all queries is one aggregation by key, in which a
text that stands in many rows counts once on the map side; what is left are the candidates (key, rules) that satisfy
some query. They go back to the texts, and a rule's expression runs on its candidates alone, which verifies them. Rules
without mandatory trigrams scan every text. Two texts of one hash only share candidates, never matches.

Few candidates are broadcast, by a count; many are joined by key, where AQE may split a text that a third of the rows
hold. Texts without any trigram of the vocabulary are in no posting.

Defined results: a null text is empty; rows that repeat a doc_id are scanned each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import discard, join_checked, materialize, sha256_of_spans
from modgraph.llm.spans import find_spans, no_spans

#: Fixed values: (kind, expression, group, shortest length of the group) of the base rules.
BASE_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Well-known formats of issued credentials.
MORE_RULES = [
    ("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abps]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 27),
    ("bearer", r"(?i:bearer)\x20[A-Za-z0-9._~+/=-]{20,}", 0, 27),
    ("login", r"[a-z]{2,12}://[A-Za-z0-9._-]{2,40}:[A-Za-z0-9._~!$-]{3,80}@", 0, 10),
]
MOST_STRINGS = 64

# ---- Boolean trigram queries: True, a trigram, or ("and" | "or", [queries])


def conjunction(parts: list) -> object:
    flat: list = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    unique = list(dict.fromkeys(x if isinstance(x, str) else (x[0], tuple(x[1])) for x in flat))
    return True if not unique else unique[0] if len(unique) == 1 else ("and", unique)


def disjunction(parts: list) -> object:
    if not parts or any(p is True for p in parts):
        return True
    unique = list(dict.fromkeys(p if isinstance(p, str) else (p[0], tuple(p[1])) for p in parts))
    sets = [frozenset((p,) if isinstance(p, str) else p[1]) if isinstance(p, str) or p[0] == "and" else None for p in unique]
    # an alternative that asks for all that another asks for, and more, adds nothing
    unique = [p for p, own in zip(unique, sets) if own is None or not any(x is not None and x < own for x in sets)]
    return unique[0] if len(unique) == 1 else ("or", unique)


def of_strings(strings: set[str]) -> object:
    """What a text with one of the strings must contain."""
    return disjunction([conjunction([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(regex: str) -> object:
    """The Boolean query of trigrams mandatory for a match, for lower-cased ASCII text."""

    def walk(nodes) -> tuple[set[str] | None, list]:
        """The exact strings a sequence can be, if few, and the queries collected on the way."""
        strings: set[str] = {""}
        queries: list = []
        exact = True

        def flush() -> None:
            nonlocal strings, exact
            queries.append(of_strings(strings))
            strings, exact = {""}, False

        for op, value in nodes:
            name, some = str(op), None
            if name == "LITERAL":
                some = {chr(value).lower()}
            elif name == "SUBPATTERN":
                some, more = walk(value[-1])
                queries += more
            elif name == "BRANCH":
                branches = [walk(b) for b in value[1]]
                if all(s is not None for s, _ in branches):
                    some = set().union(*(s for s, _ in branches))
                else:
                    queries.append(disjunction([conjunction([*q, of_strings(s or {""})]) for s, q in branches]))
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                some = {chr(v).lower() for _, v in value}
            elif name == "MAX_REPEAT":
                least, most, inner = value
                body, more = walk(inner)
                if least:
                    queries += more
                if body is not None and int(most) <= 1:
                    some = body | ({""} if not least else set())
            elif name == "AT":
                some = {""}
            if some is not None and len(some) * len(strings) <= MOST_STRINGS:
                strings = {a + b for a, b in product(strings, some)}
            else:
                flush()
                if some is not None and len(some) <= MOST_STRINGS:
                    strings = set(some)
        if exact:
            return strings, queries
        queries.append(of_strings(strings))
        return None, queries

    strings, queries = walk(re._parser.parse(regex))
    return shortened(conjunction([*queries, *([of_strings(strings)] if strings is not None else [])]))


def shortened(query: object, most: int = 3) -> object:
    """A query that is implied by the given one and asks for few trigrams: those with symbols, rare in prose, first."""
    if query is True or isinstance(query, str):
        return query
    kind, parts = query
    if kind == "or":
        return disjunction([shortened(p, most) for p in parts])
    words = sorted((p for p in parts if isinstance(p, str)), key=lambda t: t.isalpha())[:most]
    return conjunction([*words, *(shortened(p, most) for p in parts if not isinstance(p, str))])


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# ---- the index and the scan


def vocabulary(rules: list[tuple]) -> list[str]:
    return sorted(set().union(*(trigrams_of(trigram_query(r[1])) for r in rules)))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, rules: list[tuple] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The inverted index over the rules' vocabulary: rows (term, key); term is the trigram's place in the vocabulary."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text_key(text).alias("key"), F.lower(text).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(vocabulary(rules)))).cast("array<int>"))
    return rows.select(F.explode(has).alias("term"), "key")


def matches_query(query: object, words: list[str], maps: list[Column]) -> Column:
    """The query over bitmaps: conjunctions of trigrams become one mask."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        at = words.index(query)
        return maps[at // 62].bitwiseAND(F.lit(1 << at % 62)) != 0
    kind, parts = query
    if kind == "and":
        masks: dict[int, int] = {}
        for t in (p for p in parts if isinstance(p, str)):
            at = words.index(t)
            masks[at // 62] = masks.get(at // 62, 0) | 1 << at % 62
        tests = [maps[k].bitwiseAND(F.lit(m)) == m for k, m in masks.items()]
        tests += [matches_query(p, words, maps) for p in parts if not isinstance(p, str)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
    tests = [matches_query(p, words, maps) for p in parts]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def candidates(index: DataFrame, rules: list[tuple] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(key, rules): the texts that satisfy the query of some rule; rules holds the places of those rules."""
    words = vocabulary(rules)
    bit = lambda p: F.when(F.floor(F.col("term") / 62) == p, F.expr("shiftleft(1L, term % 62)"))
    names = [f"m{p}" for p in range(-(-len(words) // 62))] or ["m0"]
    sets = index.groupBy("key").agg(*(F.coalesce(F.bit_or(bit(p)), F.lit(0).cast("bigint")).alias(n) for p, n in enumerate(names)))
    maps = [F.col(n) for n in names]
    queries = [trigram_query(r[1]) for r in rules]
    hold = [F.when(matches_query(q, words, maps), F.lit(k)) for k, q in enumerate(queries) if q is not True]
    return sets.select("key", F.array_compact(F.array(*hold).cast("array<int>")).alias("rules")).where(F.size("rules") > 0)


def _group_is_long(regex: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(F.regexp_extract(s["value"], regex, group)) >= least


def _named(rule: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["start"].alias("start"),
        F.lit(rule).alias("rule"),
        s["end"].alias("end"),
        F.lit(kind).alias("kind"),
        s["value"].alias("value"),
    )


def scan(docs: DataFrame, base: list[tuple] = BASE_RULES, more: list[tuple] = MORE_RULES) -> DataFrame:
    """(doc_id, found): an array of (start, rule, end, kind, value) by start, then rule, per row of documents."""
    rules = [*base, *more]
    index = materialize(postings(docs, rules))
    told = materialize(candidates(index, rules))
    discard(index)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", text_key(F.col("text")))
    rows = join_checked(rows, told, "key", "left")
    parts = []
    for k, (kind, regex, group, least) in enumerate(rules):
        spans = find_spans(F.col("text"), regex)
        if trigram_query(regex) is not True:
            spans = F.when(F.array_contains("rules", k), spans).otherwise(no_spans())
        if group:
            spans = F.filter(spans, _group_is_long(regex, group, least))
        parts.append(F.transform(spans, _named(k, kind)))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def _is_rule(rule: int) -> Callable[[Column], Column]:
    return lambda s: s["rule"] == rule


def report(docs: DataFrame, base: list[tuple] = BASE_RULES, more: list[tuple] = MORE_RULES) -> DataFrame:
    """The counts of the base rules, the digest of their spans and all spans, per row of documents."""
    found = F.col("found")
    texts = lambda a: F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return scan(docs, base, more).select(
        "doc_id",
        *(F.size(F.filter(found, _is_rule(i))).cast("bigint").alias(f"n_{r[0]}") for i, r in enumerate(base)),
        sha256_of_spans(texts(F.filter(found, lambda s: s["rule"] < len(base)))).alias("base_sha256"),
        F.array_join(texts(found), ",").alias("spans"),
    )


def _either_case(regex: str) -> str:
    """Case-insensitive groups spelt out, as RE2 would also fold letters beyond ASCII."""
    spelt = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:([^)]*)\)", spelt, regex)


def duckdb_sql(base: list[tuple] = BASE_RULES, more: list[tuple] = MORE_RULES) -> str:
    """The same report as DuckDB SQL, with every rule run on every text."""
    parts = []
    for k, (kind, regex, group, least) in enumerate([*base, *more]):
        r = "'" + _either_case(regex).replace("'", "''") + "'"
        value = f"regexp_extract(m, {r}, {group})"
        parts.append(
            f"""select rid, {k} as rule, '{kind}' as kind,
  list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)::bigint as s, length(m) as n
  from (select rid, f, regexp_split_to_array(text, {r}) as g, unnest(f) as m, generate_subscripts(f, 1) as i
    from (select rid, text, regexp_extract_all(text, {r}) as f from docs) where len(f) > 0) where length({value}) >= {least}"""
        )
    joined = "\nunion all ".join(parts)
    counts = ", ".join(f"count(*) filter (where rule = {i}) as n_{r[0]}" for i, r in enumerate(base))
    text = "kind || ':' || s || ':' || (s + n)"
    agg = f"string_agg({text}, ',' order by s, rule)"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
hits as ({joined}),
sums as (select rid, {counts}, {agg} filter (where rule < {len(base)}) as b, {agg} as spans from hits group by rid)
select doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) as n_{r[0]}" for r in base)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join sums using (rid)"""
