"""Personal data: base expressions, and bootstrapped contextual extraction, with SQL functions alone.

The base expressions find seeds. Candidates are all other tokens that could be an identifier of any shape: those with a
digit or an at sign, short groups of digits in a row, and addresses with a written "(at)"; nothing says of what kind they
are. Every occurrence induces lexical patterns from the words beside it: both, the one before, the one after. Seeds and
candidates, by value, and patterns make a graph, and scores per kind go back and forth over it: a pattern scores the mean
of its values, of which seeds of the kind count one and seeds of other kinds nothing, and a candidate the mean of its
patterns. A pattern with enough distinct seeds and a high score is trusted, and its candidates are found as of its kind,
whatever their shape, if they are at least half as long as the shortest and at most twice as long as the longest seed; so
are candidates whose value is a seed elsewhere. Of several kinds the best score decides. Values and patterns are counted
in groups before they are joined, scores are written each round, so that a common pattern's partition can be split, and
only short strings, never texts, are shuffled.

Defined results: a null text is empty; rows with equal id and text agree; an added span never overlaps a base span;
other columns are carried by ``redact`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import discard, given_id, join_checked, known_id, materialize, sha256_of_spans
from modgraph.llm.spans import find_spans, no_spans

#: Fixed values: (kind, a string that every match has, the base expression). Look-behinds and possessive quantifiers
#: only save the engine from starting again inside a run; they change no match.
BASE = [
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"),
    ("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]"),
]
#: What may be an identifier: short groups of digits in a row, a token with a digit or an at sign, a written "(at)".
CANDIDATE = (
    r"(?<!\S)(?:[(+]?[0-9][0-9()+.-]{0,8}+(?: [(+]?[0-9][0-9()+.-]{0,8}+)++(?![^\s.,;:!?])"
    r"|[^\s0-9@]*+[0-9@]\S*+|\S++ [\[({]at[\])}] \S++(?: [\[({]dot[\])}] \S++)*+)"
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
CONTEXT = 48
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 5, 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a short string of digits passes the Luhn test."""
    n = F.length(value)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(value, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str) -> Callable[[Column], Column]:
    """What a match of the base expression must fulfil."""
    if kind == "ip":
        return lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return lambda s: luhn(digits(s["value"]))
    if kind == "phone":
        return lambda s: F.length(digits(s["value"])).between(8, 15)
    return lambda s: F.lit(True)


def _guarded(text: Column, needle: str, regex: str) -> Column:
    found = find_spans(text, regex)
    return F.when(text.contains(needle), found).otherwise(no_spans()) if needle else found


def base_spans(text: Column, kind: str) -> Column:
    needle, regex = next((n, r) for k, n, r in BASE if k == kind)
    return F.filter(_guarded(text, needle, regex), valid(kind))


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates without the signs around them, of which none overlaps a span of base."""

    def trimmed(s: Column) -> Column:
        left = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+(]*", 0))
        right = F.length(F.regexp_extract(s["value"], r"[^\p{L}\p{N})]*$", 0))
        n = F.greatest(s["end"] - s["start"] - left - right, F.lit(0))
        return F.struct(
            (s["start"] + left).alias("start"), (s["start"] + left + n).alias("end"), F.substring(s["value"], left + 1, n).alias("value")
        )

    apart = lambda s: (s["end"] > s["start"]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = F.when(text.rlike(r"[0-9@]|[\[({]at[\])}]"), find_spans(text, CANDIDATE)).otherwise(no_spans())
    return F.filter(F.transform(found, trimmed), apart)


def beside(text: Column, kind: str | None, spans: Column) -> Column:
    """Spans with their kind (null for candidates), value in normal form, and the words before and after them."""

    def one(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        plain = F.regexp_replace(F.regexp_replace(F.lower(s["value"]), r" ?[\[({]at[\])}] ?", "@"), r" ?[\[({]dot[\])}] ?", ".")
        value = digits(plain) if kind in ("card", "phone") else plain if kind else F.when(plain.rlike(r"[@\p{L}]"), plain).otherwise(digits(plain))
        return F.struct(
            F.lit(kind).cast("string").alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            value.alias("value"),
            F.lower(F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)).alias("prev"),
            F.lower(F.regexp_extract(after, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1)).alias("next"),
            F.lit(kind is not None).alias("seed"),
        )

    return F.transform(spans, one)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found): base occurrences and candidates of each row; key tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), *(base_spans(F.col("text"), k).alias(f"b_{k}") for k, _, _ in BASE))
    parts = [beside(F.col("text"), kind, F.col(f"b_{kind}")) for kind, _, _ in BASE]
    every = F.concat(*(F.col(f"b_{k}") for k, _, _ in BASE))
    parts.append(beside(F.col("text"), None, candidate_spans(F.col("text"), every)))
    return rows.select(known_id().alias("doc_id"), "key", F.concat(*parts).alias("found"))


def pattern_scores(edges: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, seeds, score) of patterns with a seed, from edges (pattern, value) and seeds known (kind, value)."""
    known = materialize(known)
    totals = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    sure = join_checked(edges, known, "value", "inner").groupBy("kind", "pattern").agg(F.count("*").alias("seeds"))
    sure = materialize(sure.join(totals, "pattern"))
    # only candidates beside a pattern that has seeds can get a score; seeds keep theirs
    left = join_checked(edges, known.select("value").distinct(), "value", "left_anti")
    left = materialize(left)
    widths = materialize(left.groupBy("value").agg(F.count("*").alias("patterns")))
    scored = materialize(sure.select("kind", "pattern", "seeds", "values", (F.col("seeds") / F.col("values")).alias("score")))
    for _ in range(rounds):
        by_pattern = join_checked(left, scored.select("kind", "pattern", "score"), "pattern", "inner")
        values = by_pattern.groupBy("kind", "value").agg(F.sum("score").alias("sum")).join(widths, "value")
        values = materialize(values.select("kind", "value", (F.col("sum") / F.col("patterns")).alias("value_score")))
        more = join_checked(left, values, "value", "inner").groupBy("kind", "pattern").agg(F.sum("value_score").alias("more"))
        score = (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("values")
        before, scored = scored, materialize(sure.join(more, ["kind", "pattern"], "left").select("kind", "pattern", "seeds", "values", score.alias("score")))
        discard(before, values)
    discard(left, widths, sure, known)
    return scored.drop("values")


def discovered(rows: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, key, kind, start, end) of candidates that trusted patterns or known values bring in."""
    told = rows.where(F.size("found") > 0).select("doc_id", "key", F.explode("found").alias("o")).select("doc_id", "key", "o.*")
    patterns = F.array_compact(
        F.array(
            F.when((F.col("prev") != "") & (F.col("next") != ""), F.concat_ws(" ", "prev", F.lit("_"), "next")),
            F.when(F.col("prev") != "", F.concat_ws(" ", "prev", F.lit("_"))),
            F.when(F.col("next") != "", F.concat_ws(" ", F.lit("_"), "next")),
        )
    )
    edges = materialize(told.select("value", F.explode(patterns).alias("pattern")).distinct())
    seeds = told.where("seed")
    known = materialize(seeds.select("kind", "value").distinct())
    scored = pattern_scores(edges, known, rounds)
    trusted = materialize(scored.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score)).select("kind", "pattern", "score"))
    n = F.col("end") - F.col("start")
    lengths = materialize(seeds.groupBy("kind").agg(F.min(n).alias("shortest"), F.max(n).alias("longest")))  # a row per kind
    open_rows = told.where("not seed").select("doc_id", "key", "start", "end", "value", patterns.alias("patterns"))
    by_pattern = open_rows.select("doc_id", "key", "start", "end", F.explode("patterns").alias("pattern"))
    found = join_checked(by_pattern, trusted, "pattern", "inner").join(F.broadcast(lengths), "kind")
    found = found.where((2 * n >= F.col("shortest")) & (n <= 2 * F.col("longest"))).select("doc_id", "key", "start", "end", "kind", "score")
    again = join_checked(open_rows, known, "value", "inner").select("doc_id", "key", "start", "end", "kind", F.lit(1.0).alias("score"))
    rank = F.array_position(F.array(*(F.lit(k) for k, _, _ in BASE)), F.col("kind"))
    best = F.max_by("kind", F.struct("score", -rank)).alias("kind")
    return found.unionByName(again).groupBy("doc_id", "key", "start", "end").agg(best).select("doc_id", "key", "kind", "start", "end")


def _with_discovered(rows: DataFrame) -> DataFrame:
    """rows with ``more``, the discovered spans of each."""
    more = discovered(rows).groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    return join_checked(rows, materialize(more), ["doc_id", "key"], "left")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans, per row of documents."""
    rows = _with_discovered(materialize(occurrences(docs)))
    seeds = F.filter("found", lambda s: s["seed"])

    def ordered(spans: Column) -> Column:
        rank = lambda s: F.array_position(F.array(*(F.lit(k) for k, _, _ in BASE)), s["kind"])
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
        return F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"]))

    plain = F.transform(seeds, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return rows.select(
        given_id().alias("doc_id"),
        *(F.size(F.filter("found", _is_seed(k))).cast("bigint").alias(f"n_{k}") for k, _, _ in BASE),
        sha256_of_spans(ordered(plain)).alias("base_sha256"),
        F.array_join(ordered(both), ",").alias("spans"),
    )


def _is_seed(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["seed"] & (s["kind"] == kind)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, in the order of starts, replaced by its kind in brackets; overlaps are merged."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["start"] >= state["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(gap, name)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(
        spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans masked and n_chars, where there is one, brought up to date.

    The base spans are found again beside the text, so that only the rows of discovered spans are joined to it.
    """
    more = discovered(materialize(occurrences(docs))).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", "end", "kind")).alias("_more")
    )
    more = materialize(more).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_more")
    text = F.col("_text")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), known_id().alias("_id"), F.coalesce("text", F.lit("")).alias("_text")
    )
    rows = join_checked(rows.withColumn("_key", F.xxhash64("_text")), more, ["_id", "_key"], "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = [F.transform(base_spans(text, k), _plain(k)) for k, _, _ in BASE]
    rows = rows.select("_row", "_text", F.array_sort(F.concat(*parts, F.coalesce("_more", none))).alias("_spans"))
    hit = F.size("_spans") > 0
    rows = rows.select("_row", hit.alias("_hit"), F.when(hit, masked(text, F.col("_spans"))).alias("_masked"))
    new = {
        "text": F.when(F.col("_hit"), F.col("_masked")).otherwise(F.col("_row.text")),
        "n_chars": F.when(F.col("_hit"), F.length("_masked").cast("bigint")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None,
    }
    return rows.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


def _plain(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
