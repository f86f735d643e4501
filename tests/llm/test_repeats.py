import hashlib
import random

import numpy as np
import pytest

from modgraph.llm import repeats

SCHEMA = "doc_id bigint, text string, lang string, spans int"


def brute(rows, length, keep_first):
    seen = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, data[i][1]))
    for i in order:
        text = data[i][1]
        for at in range(len(text) - length + 1):
            seen.setdefault(text[at : at + length], []).append((i, at))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places[1 if keep_first else 0 :]:
                gone[i].update(range(at, at + length))
    out = []
    for (doc, text), g in zip(data, gone):
        kept = bytes(b for i, b in enumerate(text) if i not in g)
        spans = sum(i in g and i - 1 not in g for i in range(len(text)))
        out.append((doc, len(text), len(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "bé", "c", "delta,", "ee", "ff\n", "中"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [make(rng.randint(5, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(0, 25)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, " ".join(parts), "en", 1))
    rows += [(100, None, None, None), (101, "", "", 0), (102, "x" * 300, "", 0), (103, "ab" * 200, "", 0), (104, rows[3][1], "", 0), (105, rows[3][1], "", 0)]
    rows += [(106, make(40), "", 0)] * 2
    rows += [(None, rows[5][1], "", 0), (None, None, None, None)]
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("length", "seed"), [(60, 1), (100, 2), (400, 3)])
def test_all_copies_match_brute_force(spark, length, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repeats.remove_repeats(docs, length, keep_first=False)) == brute(rows, length, False)


@pytest.mark.parametrize("most", [4096, 1])
def test_later_copies_and_large_groups_match_brute_force(spark, most):
    rows = [r for r in corpus(4) if r[0] != 106]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repeats.remove_repeats(docs, 80, True, most_contexts=most)) == brute(rows, 80, True)
    assert result(repeats.remove_repeats(docs, 80, False, most_contexts=most)) == brute(rows, 80, False)


def test_long_texts_are_cut_into_buffers(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    rows = [(1, text + text[500:1500] + text[:700], "", 0), (2, "z" * 2_000, "", 0), (3, text[900:2000], "", 0)]
    got = []
    monkeypatch.setattr(repeats, "BUFFER", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * 3), pa.array([r[1] for r in rows])], ["doc_id", "key", "text"])
    for out in repeats.find_anchors(400)(iter([batch])):
        got += zip(*(out.column(c).to_pylist() for c in ("doc_id", "pos", "lo", "wins")))
    for doc, text, *_ in rows:
        windows = sorted(w for d, pos, lo, wins in got if d == doc for w in range(pos - lo, pos - lo + wins))
        assert windows == list(range(len(text) - 399))


def test_previous_factors():
    for text in (b"", b"a", b"aaaa", b"abaababaab", b"mississippi"):
        want = [max([0, *(next(k for k in range(len(text) - i + 1) if k == len(text) - i or text[i + k] != text[j + k]) for j in range(i))]) for i in range(len(text))]
        assert repeats.longest_previous_factor(text) == want


def test_suffix_order_agrees_with_previous_factors():
    rng = random.Random(8)
    contexts, lo = [], []
    for _ in range(40):
        left, right = rng.randint(0, 6), rng.randint(8, 14)
        contexts.append(bytes(rng.choice(b"ab") for _ in range(left)) + b"Q" + bytes(rng.choice(b"ab") for _ in range(right)))
        lo.append(left)
    group = np.array([i // 10 for i in range(40)])
    position = np.array(rng.sample(range(40), 40))
    earlier, later = repeats.repeated_windows(contexts, group, np.array(lo), position, 6)
    for i in range(40):
        for at in range(len(contexts[i])):
            column = max(lo) - lo[i] + at
            window = contexts[i][at : at + 6]
            same = [j for j in range(40) if j != i and group[j] == group[i] and len(window) == 6 and 0 <= at - lo[i] + lo[j] and contexts[j][at - lo[i] + lo[j] : at - lo[i] + lo[j] + 6] == window]
            assert earlier[i, column] == any(position[j] < position[i] for j in same)
            assert later[i, column] == any(position[j] > position[i] for j in same)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_of_words(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [make(rng.randint(30, 70)) for _ in range(12)]
    rows = []
    for i in range(80):
        words = make(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "", 0))
    rows += [(90, " ".join(["again"] * 200), "", 0), (91, None, "", 0), (92, rows[0][1], "", 0), (92, rows[0][1], "", 0), (None, rows[1][1], "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.doc_id, r.kept_sha256): r.n_passage_words for r in repeats.remove_repeats(docs, 400, False, with_bytes=False, passage=50).collect()}
    assert len(got) == len(rows) - 1
    holders = {}
    for n in (35, 50):
        for d, text, *_ in rows:
            w = (text or "").split()
            for k in range(len(w) - n + 1):
                holders.setdefault((n, *w[k : k + n]), set()).add(d)
    by_doc = {}
    for (d, _), n in got.items():
        by_doc[d] = n
    for d, text, *_ in rows:
        w = (text or "").split()
        under = {n: {x for k in range(len(w) - n + 1) if len(holders[(n, *w[k : k + n])]) > 1 for x in range(k, k + n)} for n in (35, 50)}
        assert by_doc[d] <= len(under[35])
        assert (by_doc[d] >= 35) == bool(by_doc[d])
        if under[50]:
            assert by_doc[d]
