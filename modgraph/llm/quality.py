"""Quality rules with risk-controlled cutoffs.

Each document gets a few counts in one pass. Every rule compares a rate with a cutoff from a fixed ladder. Labelled
documents are halved by a hash of their id: the tuning half proposes, per stratum, a cutoff for each rule and an order
of the rules; the holdout half tests the nested policies "first rule", "first two rules", ... in that order. A policy
is certified when an exact binomial test rejects "it turns away more than ``risk`` of the good documents" at level
``delta`` / number of strata (Bonferroni across strata; a fixed order needs no correction within one, and testing stops
at the first failure). So with probability 1 - delta no stratum loses more than ``risk`` of its good documents.
A stratum without enough labels keeps every document that the base rules keep.

Defined results: a null text has no words and fails the base rule; a null stratum is the stratum ""; a label that is
null is ignored; of several labels for one id the lowest counts; repeated rows each get their own verdict.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import each_text, join_checked, materialize

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_upper",
    "n_marks",
)
COUNTS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

#: The ladders of cutoffs, lenient first. A rule turns away a document whose rate is above its cutoff.
LADDERS = {
    "symbol_rate": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "upper_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mark_rate": (1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_rate": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "reuse_rate": (0.95, 0.93, 0.9, 0.87, 0.84, 0.8, 0.75),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.split()]
    covered = 0
    if n > 3 and len(set(zip(words, words[1:], words[2:]))) < n - 2:
        times: dict = {}
        for w in zip(words, words[1:], words[2:]):
            times[w] = times.get(w, 0) + 1
        end = 0
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if times[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    plain = len(text.translate(None, b"#*$%&|<>"))
    return (
        n,
        len(joined.decode("utf-8", "replace")),
        len(text) - plain,
        len(lines) - len(set(lines)),
        covered,
        len(lines),
        len(set(words)),
        len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count(b"!"),
    )


def _count_column(text: pa.Array) -> pa.Array:
    rows = [count_text(t) for t in each_text(text)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(COUNTS))], list(COUNTS))


def text_counts(text: str) -> Column:
    """The counts of a text; marked so that the optimizer does not evaluate them once more for a filter on them."""
    return F.arrow_udf(_count_column, COUNTS_TYPE).asNondeterministic()(text)


def base_failed(c: str = "") -> Column:
    n, repeated = F.col(f"{c}n_words"), F.col(f"{c}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def rates(c: str = "") -> dict[str, Column]:
    def share(top: str, bottom: str) -> Column:
        return F.when(F.col(c + bottom) > 0, F.col(c + top) / F.col(c + bottom)).otherwise(F.lit(0.0))

    return {
        "symbol_rate": share("n_symbols", "word_chars"),
        "upper_rate": share("n_upper", "word_chars"),
        "mark_rate": share("n_marks", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "reuse_rate": F.when(F.col(c + "n_words") > 0, 1 - F.col(c + "n_distinct") / F.col(c + "n_words")).otherwise(F.lit(0.0)),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def propose(tuning: dict[tuple[str, str, int, int], int], risk: float) -> dict[str, list[tuple[str, float]]]:
    """Per stratum, rules in the order of the junk they catch, each at the strictest cutoff that looks safe.

    tuning: (stratum, rule, quality, ladder steps exceeded) -> labelled documents of the tuning half.
    """
    out: dict[str, list[tuple[str, float]]] = {}
    for stratum in sorted({k[0] for k in tuning}):
        found = []
        for rule, ladder in LADDERS.items():
            count = [[tuning.get((stratum, rule, q, s), 0) for s in range(len(ladder) + 1)] for q in (0, 1)]
            good = sum(count[1])
            for step in range(1, len(ladder) + 1):  # whoever exceeds so many cutoffs exceeds the strictest of them
                lost, caught = sum(count[1][step:]), sum(count[0][step:])
                if good and lost <= good * risk / (2 * len(LADDERS)) and caught > lost:
                    found.append((-caught, lost, rule, ladder[-step]))
                    break
        out[stratum] = [(rule, cut) for _, _, rule, cut in sorted(found)]
    return out


def certify(
    proposals: dict[str, list[tuple[str, float]]], holdout: dict[tuple[str, int], int], risk: float, delta: float
) -> dict[str, list[tuple[str, float]]]:
    """The longest certified policy of each stratum.

    holdout: (stratum, place in the stratum's order of the first rule that turns a good document away, or the number of
    rules if none does) -> good documents of the holdout half.
    """
    out = {}
    for stratum, rules in proposals.items():
        good = sum(c for (s, _), c in holdout.items() if s == stratum)
        lost, kept = 0, 0
        for place in range(len(rules)):
            lost += holdout.get((stratum, place), 0)
            if not good or binomial_tail(lost, good, risk) > delta / len(proposals):
                break
            kept = place + 1
        out[stratum] = rules[:kept]
    return out


def _first_rule(policy: dict[str, list[tuple[str, float]]], stratum: Column) -> Column:
    """The place of the first rule of the stratum's order that a row exceeds, else the number of rules; null: no stratum."""
    rate, out = rates(), None
    for name, rules in sorted(policy.items()):
        place = F.lit(len(rules))
        for i in range(len(rules) - 1, -1, -1):
            place = F.when(rate[rules[i][0]] > rules[i][1], i).otherwise(place)
        out = F.when(stratum == name, place) if out is None else out.when(stratum == name, place)
    return F.lit(None).cast("int") if out is None else out


Policy = dict[str, list[tuple[str, float]]]
#: Policies of many strata, as a table.
POLICY = "stratum string, rules array<struct<rule:string,cut:double>>"


def calibrate(features: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, most_strata: int = 500) -> Policy | DataFrame:
    """Certified rules per stratum from features (doc_id, stratum, COUNTS) and labels (doc_id, quality).

    What reaches the driver is counts per stratum, rule and ladder step. Of more than ``most_strata`` strata with labels
    nothing does: each stratum's counts are judged in a group of their own and the policy is a table, with the same rules.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    labelled = features.where(~base_failed()).join(known, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    labelled = materialize(labelled)
    steps = F.array(
        *(
            F.struct(
                F.lit(rule).alias("rule"),
                sum((F.when(rate > cut, 1).otherwise(0) for cut in LADDERS[rule]), F.lit(0)).alias("step"),
            )
            for rule, rate in rates().items()
        )
    )
    seen = labelled.where("half = 0").select("stratum", "quality", F.explode(steps).alias("s"))
    seen = seen.groupBy("stratum", "s.rule", "quality", "s.step").agg(F.count("*").alias("c"))
    good = labelled.where("half = 1 and quality = 1")
    if labelled.select("stratum").distinct().limit(most_strata + 1).count() > most_strata:
        return _calibrate_many(seen, good, risk, delta)
    proposals = propose({(r.stratum, r.rule, r.quality, r.step): r.c for r in seen.collect()}, risk)
    held = good.groupBy("stratum", _first_rule(proposals, F.col("stratum")).alias("place")).count().where("place is not null")
    return certify(proposals, {(r[0], r[1]): r[2] for r in held.collect()}, risk, delta)


def _calibrate_many(seen: DataFrame, good: DataFrame, risk: float, delta: float) -> DataFrame:
    """The policy (POLICY) of strata that are too many for the driver."""
    import pandas as pd  # other workers do without it

    def proposed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {(key[0], r.rule, r.quality, r.step): r.c for r in rows.itertuples()}
        rules = propose(counts, risk)[key[0]]
        return pd.DataFrame({"stratum": [key[0]], "rules": [[{"rule": r, "cut": c} for r, c in rules]]})

    proposals = materialize(seen.groupBy("stratum").applyInPandas(proposed, POLICY))
    strata = proposals.count()

    def certified(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rules = [(r["rule"], r["cut"]) for r in rows["rules"].iloc[0]]
        held = {(key[0], int(p)): int(c) for p, c in zip(rows["place"], rows["c"])}
        kept = certify({key[0]: rules}, held, risk, delta / strata)[key[0]]
        return pd.DataFrame({"stratum": [key[0]], "rules": [[{"rule": r, "cut": c} for r, c in kept]]})

    at = F.array_position(F.transform("rules", _exceeds()), True)
    place = F.when(at > 0, at - 1).otherwise(F.size("rules")).alias("place")
    held = join_checked(good, proposals, "stratum", "inner").groupBy("stratum", "rules", place).agg(F.count("*").alias("c"))
    return materialize(held.groupBy("stratum").applyInPandas(certified, POLICY))


def _exceeds():
    rate = F.create_map(*(x for name, r in rates().items() for x in (F.lit(name), r)))
    return lambda rule: F.element_at(rate, rule["rule"]) > rule["cut"]


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, COUNTS) of documents (doc_id, text, the stratum column)."""
    return docs.select(
        "doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), text_counts("text").alias("c")
    ).select("doc_id", "stratum", "c.*")


def judged(features: DataFrame, policy: Policy | DataFrame) -> DataFrame:
    """features with base_failed and kept."""
    if isinstance(policy, DataFrame):
        rows = join_checked(features, policy.withColumnRenamed("rules", "_rules"), "stratum", "left")
        turned = F.coalesce(F.exists("_rules", _exceeds()), F.lit(False))
        rows = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~turned)
        return rows.select(*features.columns, "base_failed", "kept")
    rate, turned = rates(), F.lit(False)
    for name, rules in sorted(policy.items()):
        if rules:
            any_rule = F.greatest(*(rate[r] > cut for r, cut in rules), F.lit(False))
            turned = F.when(F.col("stratum") == name, any_rule).otherwise(turned)
    return features.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~turned)


def quality_report(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    features = materialize(measured(docs))
    return judged(features, calibrate(features, labels, risk, delta))


def keep_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that are kept, with all their columns; texts are counted twice rather than shuffled."""
    policy = calibrate(measured(docs), labels, risk, delta)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    counted = docs.select(row, F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text_counts("text").alias("_counts"))
    return judged(counted.select("_row", "stratum", "_counts.*"), policy).where("kept").select("_row.*")
