import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modgraph.llm import decontaminate as dc

SCHEMA = "doc_id bigint, text string, lang string, key string, n int"


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items, similarity=0.8):
    best = {}
    for doc, text, *_ in docs:
        w = words(text)
        for item, target in items:
            t = words(target)
            if not t or not w:
                continue
            for start in range(max(1, len(w) - len(t) + 1)):
                a, b = shingles(w[start : start + len(t)]), shingles(t)
                shared = sum((a & b).values())
                score = shared / (sum(a.values()) + sum(b.values()) - shared)
                if score >= similarity:
                    best[doc, item] = max(best.get((doc, item), 0), score)
    return best


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([12, 20, 40, 40, 90])))) for i in range(20)]
    items += [(90, None), (91, ""), (92, "three word item"), (93, "Solo"), (94, "a b c d e"), (95, "x x x x x x x x x x x x")]
    docs = []
    for i in range(80):
        w = make(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            piece = items[rng.randrange(20)][1].split()
            change = rng.randint(0, 3)
            for _ in range(change):
                at = rng.choice([0, 1, len(piece) - 1, rng.randrange(len(piece))])
                what = rng.randint(0, 2)
                if what == 0:
                    piece[at] = rng.choice(vocabulary)
                elif what == 1:
                    piece.insert(at, rng.choice(vocabulary))
                elif len(piece) > 5:
                    del piece[at]
            at = rng.randint(0, len(w))
            w[at:at] = [p.upper() + rng.choice(["", ",", "."]) for p in piece]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(w), "en", "k", 1))
    docs += [(200, None, None, None, None), (201, "", "", "", 0), (202, "Three, word: item!", "", "", 0), (203, "solo", "", "", 0), (204, items[0][1], "", "", 0), (204, items[0][1], "", "", 0), (205, "x " * 500, "", "", 0), (206, " ".join(items[4][1].split()[:-1]), "", "", 0), (None, items[7][1], "", "", 0), (None, None, None, None, None)]
    items += [(None, "an item that has no id of its own but ten words")]
    docs += [(207, "so an item that has no id of its own but ten words", "", "", 0)]
    return docs, items


def test_items_match_brute_force(spark):
    docs, items = corpus()
    found = dc.contained_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = brute(docs, items)
    assert len(want) > 40
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_shingles_are_joined_with_salts(spark, monkeypatch):
    docs, items = corpus()
    tables = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, dc.contained_items(*tables).collect()), key=str)
    monkeypatch.setattr(dc, "MOST_SHINGLES", 0)
    assert sorted(map(tuple, dc.contained_items(*tables).collect()), key=str) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_all_windows(spark, seed):
    """Items with words put in, left out and changed all over, near the threshold; the radius may lose a tenth."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([15, 25, 40, 59])))) for i in range(40)]
    docs = []
    for i in range(240):
        piece = rng.choice(items)[1].split()
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            at = rng.randrange(len(piece))
            piece[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(around))
        docs.append((i, " ".join([*around[:at], *piece, *around[at:]]), "en", "", 0))
    want = brute(docs, items)
    found = dc.contained_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want) > 50 and got <= want.keys()
    print("recall", len(got), len(want))
    assert len(got) >= 0.9 * len(want)


def test_clean_documents_keeps_the_others_whole(spark):
    docs, items = corpus()
    hit = {d for d, _ in brute(docs, items)}
    df = spark.createDataFrame(docs, SCHEMA)
    kept = dc.clean_documents(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((d for d in docs if d[0] not in hit or d[1] is None), key=str)


@pytest.mark.parametrize(("radius", "blocks"), [(23, 8), (5, 4), (16, 16)])
def test_index_finds_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    pairs = []
    for i in range(60):
        a = rng.getrandbits(64)
        flips = rng.sample(range(64), rng.randint(0, radius))
        b = a
        for f in flips:
            b ^= 1 << f
        pairs.append((i, a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b))
    df = spark.createDataFrame(pairs, "i int, a bigint, b bigint")
    met = df.where(F.arrays_overlap(dc.block_values("a", radius, blocks, False), dc.block_values("b", radius, blocks, True)))
    assert met.count() == len(pairs)


def test_simhash_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(rng.randint(0, 30))]) for i in range(20)]
    got = dict(spark.createDataFrame(rows, "i int, s array<bigint>").select("i", dc.simhash_of("s")).collect())
    for i, hashes in rows:
        assert got[i] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_empty_tables(spark):
    docs, items = corpus()
    some, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.contained_items(none, bench).count() == 0
    assert dc.contained_items(some, bench.limit(0)).count() == 0
    assert dc.clean_documents(some, bench.limit(0)).count() == len(docs)
