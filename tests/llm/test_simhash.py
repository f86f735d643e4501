import random
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from modgraph.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, fp int"


def brute_fingerprint(text, words=3):
    got = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not got:
        return 0
    grams = [" ".join(got[i : i + words]) for i in range(max(1, len(got) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def wide_prints(texts):
    """The second 64 bits of each text's fingerprint."""
    return [simhash.majority(simhash.mixed(simhash.shingle_hashes((t or "").encode(), 3))) % 2**64 for t in texts]


def candidates(prints, wide, i, j):
    d = (prints[i] ^ prints[j]).bit_count()
    return d <= 13 and d + (wide[i] ^ wide[j]).bit_count() <= 24


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" \n".join(copy))
    return [*texts, None, "", " \t\n", "one", "ONE", "one two", texts[0], texts[0], "long " * 30_000]


def test_fingerprint_matches_brute_force():
    for text in corpus():
        got = simhash.fingerprint(text.encode() if text is not None else None)
        assert got % 2**64 == brute_fingerprint(text)


def test_components_match_brute_force_for_sliced_and_counted_tiles(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], SCHEMA)
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    for radius in (2, 8):
        got = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, radius=radius).collect()}
        assert got == brute_components(prints, radius)


def test_links_of_all_tile_forms_are_complete(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    more = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:80] for i, j in [rng.integers(0, 64, 2)]]
    values = sorted({*map(int, base), *more, 0, 2**64 - 1, 2**64 - 2})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v, v) for v in signed], "fp bigint, id bigint")
    want = brute_components({v: v for v in values}, 2)
    for dealt in (simhash._sliced(fps, 2, 4), simhash._sliced(fps, 2, 8), simhash._counted(fps, 2, len(values), 4)):
        links = dealt.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(simhash.compare_tiles(2), simhash.EDGE_TYPE)
        from modgraph.llm.common import components

        got = {r.node % 2**64: r.root % 2**64 for r in components(links).collect()}
        groups = {}
        for v in values:
            groups.setdefault(got.get(v, v), set()).add(v)
        wanted = {}
        for v, r in want.items():
            wanted.setdefault(r, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_copies_match_brute_force(spark):
    texts = corpus(9, 40)
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], SCHEMA)
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    wide = wide_prints(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            near = a and b and len(a & b) >= 0.8 * len(a | b) and candidates(prints, wide, i, j)
            if (texts[i] or "") == (texts[j] or "") or near:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    for tile_rows in (1024, 3):
        got = {r.doc_id: r.group_id for r in simhash.near_copies(docs, tile_rows=tile_rows).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect() if r.doc_id) == [(1, 1)]
    assert [tuple(r) for r in simhash.near_copies(docs).collect()] == [(1, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.near_copies(docs).count() == 0
