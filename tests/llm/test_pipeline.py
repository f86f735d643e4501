import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from modgraph.llm import quality, simhash
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_pii import brute_base
from tests.llm.test_simhash import brute_fingerprint, candidates, wide_prints

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("st", "br", "kl", "m", "tr") for b in ("one", "ate", "ill", "ump", "erd", "isk", "oan", "ube")]
    make = lambda n: [rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(i, " ".join(make(25))) for i in range(4)]
    docs, labels = [], []
    for i in range(900):
        w = make(rng.randint(60, 120))
        if i % 9 == 0:
            w = [x + "%%%" for x in w]
        labels.append((i, int(i % 9 != 0), 0))
        if i % 50 == 1:
            w[10:10] = items[i % 4][1].split()
        if i % 40 == 2:
            w[5:5] = ["mail", f"user{i}@mail.example.com", "call", "+1 (743) 555-3824"]
        docs.append((i, " ".join(w), "en", "s", 0))
    for i in range(40):
        w = docs[i * 5 + 3][1].split()
        if i % 2:
            w[0] = "changed1"
        docs.append((1000 + i, " ".join(w), "en", "s", 0))
    docs += [(2000, "too short", "en", "s", 0), (2001, None, None, None, None), (2002, "", "en", "s", 0), (2003, " ".join(make(6000)), "en", "s", 0)]
    return docs, labels, items


def brute(docs, labels, items, policy):
    """The documents that stay, with their final texts."""
    kept = []
    for d in docs:
        c = dict(zip(quality.COUNTS, quality.count_text(None if d[1] is None else d[1].encode())))
        junk = any(rule == "symbol_rate" and c["n_symbols"] > cut * c["word_chars"] for rule, cut in policy.get(d[2] or "", []))
        if c["n_words"] >= 50 and not junk and 100 * c["n_repeat_words"] <= 50 * c["n_words"]:
            kept.append(d)
    sets = [set(simhash.shingle_hashes(d[1].encode(), 5).tolist()) for d in kept]
    prints = [brute_fingerprint(d[1]) for d in kept]
    wide = wide_prints([d[1] for d in kept])
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and candidates(prints, wide, i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [d for i, d in enumerate(kept) if find(i) == i]
    hit = {d for d, _ in brute_items(kept, items)}
    out = {}
    for d in kept:
        if d[0] not in hit:
            text, at = "", 0
            for kind, a, b in sorted(brute_base(d[1]), key=lambda s: s[1]):
                if a >= at:
                    text += d[1][at:a] + f"[{kind.upper()}]"
                at = max(at, b)
            out[d[0]] = text + d[1][at:]
    return out


def test_run_matches_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    frames = {
        "documents": spark.createDataFrame(docs, SCHEMA),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    policy = quality.calibrate(quality.measured(frames["documents"]), frames["labels"])
    assert [r for r, _ in policy["en"]] == ["symbol_rate"]
    want = brute(docs, labels, items, policy)
    assert 700 < len(want) < 820 and 2003 in want
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, text in want.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        assert sorted(pieces[doc]) == [(i, i * 2048, min(2048, n - i * 2048)) for i in range(-(-n // 2048))]
    for found in sequences.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, n in found) <= 2048


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = SCHEMA + ", key int, fp string, kept boolean, _text int"
    some = spark.createDataFrame([(*d, 1, "f", True, 3) for d in docs[:30]] + [(*docs[1], 1, "f", True, 3)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, str(tmp_path)).columns == some.columns
        assert stage(spark, some.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, some.limit(0), str(tmp_path)).count() == 0
