import random
import re

from modgraph.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def texts(seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        vocabulary = [rng.choice(["é", "a", "B", "#", "|", "ß x"]) * rng.randint(1, 3) for _ in range(rng.choice([3, 40]))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t", "  ", "\n\n"]) for _ in range(rng.randint(0, 90))))
    return [*out, None, "", "  ", "a", "a b c", "a a a a", "\n\n", "x\x0by\x0cz"]


def test_counts_match_brute_force():
    for text in texts():
        assert quality.count_text(None if text is None else text.encode())[:5] == brute(text)


def test_binomial_tail():
    assert abs(quality.binomial_tail(0, 100, 0.05) - 0.95**100) < 1e-12
    assert abs(quality.binomial_tail(2, 4, 0.5) - 11 / 16) < 1e-12
    assert quality.binomial_tail(5, 5, 0.3) == 1.0


def corpus(n=2400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randint(1, 6) + str(rng.randint(0, 40)) for _ in range(80)]
        junk = i % 6 == 0
        text = " ".join(w + "%%%" if junk else w for w in words)
        rows.append((i, text, "en" if i % 3 else "xx" if i % 50 else None, 7))
        labels.append((i, 0 if junk else 1, 0))
    rows += [(n, None, "en", 0), (n + 1, "", None, 0), (n + 1, "short", "en", 0)]
    return rows, [*labels, (5, None, None), (7, 1, 0)]


def test_certified_rules_reject_junk_and_keep_good(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.quality_report(docs, known).collect()
    assert len(got) == len(rows)
    en = [r for r in got if r.stratum == "en" and r.doc_id < 2400]
    assert not any(r.kept for r in en if r.doc_id % 6 == 0)
    assert all(r.kept for r in en if r.doc_id % 6)
    assert not any(r.kept for r in got if r.doc_id >= 2400)
    kept = quality.keep_quality(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_the_strictest_safe_cutoff_is_proposed():
    ladder = quality.LADDERS["symbol_rate"]
    # junk exceeds the two strictest cutoffs, good documents none
    seen = {("s", "symbol_rate", 0, 2): 30, ("s", "symbol_rate", 1, 0): 900}
    assert quality.propose(seen, 0.05)["s"] == [("symbol_rate", ladder[-1])]
    # a tenth of the good ones exceed the strictest
    seen |= {("s", "symbol_rate", 1, 1): 100}
    assert quality.propose(seen, 0.05)["s"] == [("symbol_rate", ladder[-2])]


def test_false_rejection_stays_limited_on_fresh_data():
    """Over many draws in which no cutoff is safe, a policy is certified in at most delta of them."""
    rng = random.Random(2)
    wrong = 0
    for _ in range(400):
        lost = sum(rng.random() < 0.06 for _ in range(300))
        wrong += bool(quality.certify({"s": [("symbol_rate", 0.1)]}, {("s", 0): lost, ("s", 1): 300 - lost}, 0.05, 0.05)["s"])
    assert wrong <= 400 * 0.05


def test_too_few_labels_certify_nothing():
    assert quality.certify({"s": [("symbol_rate", 0.1)]}, {("s", 1): 20}, 0.05, 0.05) == {"s": []}


def test_empty_tables(spark):
    docs, known = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality_report(docs, known).count() == 0
    assert quality.keep_quality(docs, known).count() == 0


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text + str(i), "en", i, "c", 7, 1, "b") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _quality int, stratum string, n_words int, _counts int, kept string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.keep_quality(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows


def test_many_strata_give_the_same_rules(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    features = quality.measured(docs).cache()
    few, many = quality.calibrate(features, known), quality.calibrate(features, known, most_strata=1)
    assert {s: r for s, r in few.items() if r} == {r.stratum: [(x.rule, x.cut) for x in r.rules] for r in many.collect() if r.rules}
    assert any(few.values())
    got = [sorted(map(tuple, quality.judged(features, p).collect()), key=str) for p in (few, many)]
    assert got[0] == got[1]
