import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modgraph.llm import packing

SCHEMA = "doc_id bigint, text string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    rng = random.Random(4)
    odd = ["don't", "I'LL", "<|endoftext|>", "x<|startoftext|>y", "é", "́x", "ΑΣ", "İ", "a b", "a\x1cb", "中文字", "१२", "😀👍", "##%%", " ", "ß"]
    out = ["".join(rng.choice([*odd, "the", "Ab", "q9"]) + rng.choice([" ", "\n", "\t", "", "\x0b "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return [*out, None, "", " \n", "word " * 5000, "x" * 30_000]


def test_ids_match_the_tokenizer(tokenizer):
    encode = packing.encoder(None)
    coded = encode.texts([None if t is None else t.encode() for t in texts()])
    for text, got in zip(texts(), coded):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want


def check(rows, want, capacity):
    """Every piece is there, pieces tile their documents, and sequences are gapless and within capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for doc, found in pieces.items():
        ids = want[doc]
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(-(-len(ids) // capacity)))
        for r in found:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 32])
def test_packing_is_whole(spark, tokenizer, capacity):
    rows = [(i, t, 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    used = check(packing.pack_documents(docs, capacity=capacity).collect(), want, capacity)
    least = -(-sum(map(len, want.values())) // capacity)
    assert least <= used <= least * 1.1 + 1


def test_fullest_matches_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 30)
        sums = {0}
        for length, count in counts.items():
            sums = {s + k * length for s in sums for k in range(count + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(x * k for x, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[x] for x, k in chosen.items())


def test_slots_cover_every_rank_once():
    rng = random.Random(8)
    histogram = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(200)}
    slots = packing.minimum_slack(histogram, 2048)
    for length, count in histogram.items():
        ranges = sorted((a, b) for x, a, b, *_ in slots if x == length)
        assert ranges[0][0] == 0 and ranges[-1][1] == count
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 0)] * 3 + [(None, "a b", 0)], SCHEMA)
    assert packing.pack_documents(docs).count() == 4
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_words_with_special_marks_beside_cached_stems(tokenizer):
    rng = random.Random(11)
    parts = ["hello", "Hello", "é", "x1", "<|", "|>", "<", "|", ">", "<|endoftext|>", "<|startoftext|>", "<|endof", "!", "'s", "'", "."]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    corpus = [" ".join(rng.sample(words, rng.randint(1, 20))) for _ in range(300)] + ["hello hello<| world", "Hello hello<|endoftext|>"]
    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for at in range(0, len(corpus), 40):  # later texts meet the words that earlier ones left in the cache
        part = corpus[at : at + 40]
        for text, got in zip(part, own.texts([t.encode() for t in part])):
            assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == tokenizer.encode(text, add_special_tokens=False).ids


def test_ranks_in_many_groups(spark, tokenizer):
    rng = random.Random(12)
    rows = [(i, "a " * rng.choice([3, 5, 5, 5, 7, 31, 40]), 0) for i in range(300)]
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t, _ in rows}
    pieces = packing.tokenized_pieces(spark.createDataFrame(rows, SCHEMA), capacity=32)
    used = check(packing.pack(pieces, 32, ranked=10).collect(), want, 32)
    assert used == check(packing.pack(pieces, 32).collect(), want, 32)


def test_plan_is_bounded():
    rng = random.Random(13)
    histogram = {n: rng.randint(1, 10**9) for n in range(1, 2048)}
    assert len(packing.minimum_slack(histogram, 2048)) < 1_100_000
