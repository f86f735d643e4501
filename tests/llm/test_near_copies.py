import random

import numpy as np

import corpus_pipeline
from modgraph.llm import simhash


def shingles(text, words=5):
    return set(simhash.shingle_hashes(text.encode(), words).tolist())


def brute_groups(texts):
    """Groups by plain Jaccard, whatever the fingerprints are."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in range(len(texts))}


def far_copies(seed=5):
    """Copies near the threshold: text appended, words changed, a passage repeated; and pairs just below it."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(80):
        base = [word() for _ in range(rng.choice([60, 200, 600]))]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(int(len(base) * rng.uniform(0.2, 0.26)))])]
    for k in range(40):
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(3, 6)):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy), " ".join(base + base[20:32] * (k % 8 + 1))]
    common = [word() for _ in range(30)]
    texts += [" ".join([*common, *(word() for _ in range(20))]) for _ in range(40)]
    return texts


def test_groups_match_plain_jaccard(spark):
    texts = far_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_groups(texts)
    assert len(set(want.values())) < len(texts) - 100
    assert {r.doc_id: r.group_id for r in simhash.near_copies(docs).collect()} == want


def test_the_order_of_shingles_loses_no_link(spark, monkeypatch):
    """Every pair of the similarity is linked by fingerprints, over any path, or listed; whatever the tiles are."""
    texts = far_copies(6)
    schema = "node bigint, part bigint, fp bigint, more bigint, text string"
    prints = [simhash.shingle_hashes(t.encode(), 3) for t in texts]
    rows = [(i, i, simhash.majority(h), simhash.majority(simhash.mixed(h)), t) for i, (h, t) in enumerate(zip(prints, texts))]
    sets = [shingles(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    close = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            x, y = (((rows[i][c] ^ rows[j][c]) % 2**64).bit_count() for c in (2, 3))
            if x <= 13 and x + y <= 24:
                close = [close[i] if c == close[j] else c for c in close]
    for count, small, hot in ((1, 32, 20_000), (20_000, 32, 20_000), (20_000, 2, 20_000), (20_000, 32, 10), (20_000, 2, 10)):
        monkeypatch.setattr(simhash, "ORDER_TEXTS", count)
        monkeypatch.setattr(simhash, "SMALL_TILE", small)
        monkeypatch.setattr(simhash, "HOT_TILE", hot)
        met = simhash.rare_meetings(spark.createDataFrame(rows, schema), len(rows), 5, 0.8, 13, 24).collect()
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in met:
            if r.near:
                root[find(r.a)] = find(r.b)
        linked = list(map(find, range(len(rows))))
        assert all(close[r.a] == close[r.b] for r in met if r.near)  # a forest over pairs that are close
        listed = {(r.a, r.b) for r in met if not r.near}
        assert all(p in listed or linked[p[0]] == linked[p[1]] for p in want)


def test_a_large_group_of_near_copies(spark):
    """Hundreds of copies, each with words of its own changed, that meet in large tiles."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            copy[at] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.group_id for r in simhash.near_copies(docs).collect()} == brute_groups(texts)


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(8)
    x, y, z, u = (" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(4))
    rows = [(5, x), (5, y), (3, x + " more"), (7, y + " more"), (9, z), (9, z), (None, z + " more"), (None, u), (None, u), (None, u + " more"), (11, None), (11, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    kept = [(r.doc_id, (r.text or "").removesuffix(" more")) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(3, x), (5, y), (9, z), (None, u), (11, "")], key=str)


def test_columns_of_any_name_stay(spark):
    rng = random.Random(10)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    rows = [(1, text, 5, "k", 2, 3, "r", 4), (2, text + " more", 6, "k", 2, 3, "r", 4), (3, "other words", 7, "k", 2, 3, "r", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, near_id int, near_key string, rows int, root int, row string, node int")
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_sketches_never_say_too_little():
    rng = np.random.default_rng(4)
    for _ in range(400):
        x, y = (rng.integers(-(2**63), 2**63 - 1, int(rng.integers(1, 400)), np.int64) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: int(rng.integers(0, len(x) + 1))]]))
        x = np.unique(x)
        shared = len(np.intersect1d(x, y))
        most = simhash.most_shared(simhash.sketch(x), len(x), simhash.sketch(y), len(y))
        assert shared <= most <= min(len(x), len(y)) * 1.5
        assert simhash.most_shared(simhash.sketch(y), len(y), simhash.sketch(x), len(x)) == most
