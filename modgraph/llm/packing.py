"""Best-fit packing by minimum bin slack.

Texts become token ids with a public tokenizer; a document's ids end with one separator id and only documents longer
than a sequence are cut. What is packed is the histogram of piece lengths: at most ``capacity`` numbers, whatever the
size of the input, so the packing itself runs on the driver. Each step takes the longest piece left and finds, by
subset-sum dynamic programming over a bitset of the available lengths, the fullest feasible combination with it; the
combination is removed as often as the counts allow. Pieces then find their places by their rank within their length:
ranks are counted in salted groups of about RANKED rows, as many as the counts ask for, so no length, however common,
meets in one task. Full pieces are sequences of their own and are neither ranked nor shuffled.

What goes to every task is the plan: after each step some length x is left with fewer pieces than the k <= capacity / x
it gave, so it ends at most capacity / x steps, all lengths together capacity * ln(capacity), and a step has at most
sqrt(2 * capacity) lengths. That is below 1.1 million entries (50 MB) at 2048 tokens, whatever the input.

Defined results: a null or empty text is the separator alone; rows that repeat a doc_id are documents of their own; the
order of equal pieces is free; other columns are not read.
"""

from __future__ import annotations

import array
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modgraph.llm.common import Batches, Mapper, join_checked, materialize, release_memory, text_bytes

CAPACITY, SEPARATOR, RANKED = 2048, 0, 100_000
PIECE_TYPE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
CACHED_WORDS = 800_000
#: Latin letters, then perhaps ASCII signs.
WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-/:-@\[-`{-~]*+)")
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level vocabularies write the bytes that Latin-1 has no printable sign for as the letters from 256 on.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
#: The byte 1 in such a vocabulary; between spaces it is a token of its own and parts words.
MARK = chr(BYTE_LETTERS[1])

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, with a bounded cache of words.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its words in turn. It also
    starts anew between a Latin letter and the ASCII sign that follows, so a word that ends in signs is looked up as a
    stem and an ending. New stems of Latin letters need no normalization but lower case, so they go many at a time to
    the tokenizer's merges alone. Case is folded beforehand unless a special token could be meant. A tokenizer of
    another build gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        folds = [n.get("type") for n in (told["normalizer"] or {}).get("normalizers", [])]
        self.by_words = "Lowercase" in folds and any(s.get("behavior") == "Removed" and s.get("invert") for s in steps)
        told.update(normalizer=None, pre_tokenizer={"type": "WhitespaceSplit"}, added_tokens=[])
        self.bare = Tokenizer.from_str(json.dumps(told)) if self.by_words else None
        self.stems: dict[bytes, bytes] = {}
        self.wholes: dict[bytes, bytes] = {}

    def forget(self) -> None:
        self.stems.clear()
        self.wholes.clear()
        release_memory()

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_words:
            return [np.array(self._encode(self.tokenizer, (t or b"").decode()), "<u4").tobytes() for t in texts]
        words = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        get = self.ids_of(set().union(*words)).__getitem__
        return [b"".join(map(get, w)) for w in words]

    def ids_of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of some words, in a table small enough for the processor's cache."""
        for cache in (self.stems, self.wholes):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        out: dict[bytes, bytes] = {}
        left = self._known(words, out)
        if left:
            stems, wholes = set(), set()
            for w in left:
                m = WORD.fullmatch(w)
                if m and b"<|" not in w:
                    stems.add(m[1])
                    if m[2]:
                        wholes.add(m[2])
                else:
                    wholes.add(w)
            self._learn(list(stems.difference(self.stems)), list(wholes.difference(self.wholes)))
            self._known(left, out)
        return out

    def _known(self, words, out: dict[bytes, bytes]) -> list[bytes]:
        """Fill in the words that the caches have; the others."""
        stem, whole, left = self.stems.get, self.wholes.get, []
        for w in words:
            ids = stem(w)
            if ids is None:
                letters = w.rstrip(SIGNS)
                if len(letters) < len(w) and (first := stem(letters)) is not None and (rest := whole(w[len(letters) :])) is not None:
                    ids = first + rest
                else:
                    ids = whole(w)  # also of a stem whose ending is not known: the word may have been learned as one
                if ids is None:
                    left.append(w)
                    continue
            out[w] = ids
        return left

    def _learn(self, stems: list[bytes], wholes: list[bytes]) -> None:
        mark = self.bare.token_to_id(f"{MARK}</w>")
        for at in range(0, len(stems), 200):
            part = stems[at : at + 200]
            text = b" ".join(part).decode().lower().encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = np.array(self._encode(self.bare, text.replace(" ", f" {MARK} ")), "<u4")
            cuts = (4 * np.flatnonzero(ids == mark)).tolist()
            raw = ids.tobytes()
            parts = [raw[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
            self.stems.update(zip(part, parts, strict=True))
        for at in range(0, len(wholes), 1000):
            part = wholes[at : at + 1000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.wholes.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found))

    @staticmethod
    def _encode(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(path: str | None, capacity: int) -> Mapper:
    def cut(batches: Batches) -> Batches:
        encode, end = encoder(path), array.array("I", [SEPARATOR]).tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                for doc, ids in zip(rows.column(0).to_pylist(), encode.texts(text_bytes(rows.column(1)))):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        part = ids[at : at + 4 * capacity]
                        for column, x in zip(out, (doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        encode.forget()  # the worker may go on to other stages, which need the memory

    return cut


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of documents (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(cut_pieces(tokenizer, capacity), PIECE_TYPE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within room; long lengths are preferred."""
    if counts.get(room):
        return {room: 1}
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            after = (reach | reach << length * take) & full
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces per sequence, offset) for all pieces."""
    counts, used, slots, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            chosen = fullest(counts, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(counts[x] // k for x, k in chosen.items())
            offset = 0
            for x, k in sorted(chosen.items(), reverse=True):
                slots.append((x, used[x], used[x] + times * k, sequence, k, offset))
                counts[x] -= times * k
                used[x] += times * k
                offset += x * k
            sequence += times
    return slots


def places(slots: list[tuple[int, int, int, int, int, int]]):
    """A function of (length, rank) columns that gives each piece its sequence and offset by the plan."""
    plan = np.array(sorted(slots), np.int64).reshape(-1, 6).T
    length, first, _, sequence, per, place = plan
    keys = length << 48 | first

    def place_of(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, rank = lengths.to_numpy(), ranks.to_numpy()
        at = np.searchsorted(keys, n << 48 | rank, side="right") - 1
        turn, nth = np.divmod(rank - first[at], per[at])
        return pa.StructArray.from_arrays([pa.array(sequence[at] + turn), pa.array(place[at] + nth * n)], ["sequence_id", "offset"])

    return F.arrow_udf(place_of, "struct<sequence_id:bigint,offset:bigint>")


def pack(pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """pieces (PIECE_TYPE) with sequence_id and offset."""
    pieces = materialize(pieces)
    histogram = dict(pieces.groupBy("length").count().collect())
    full = histogram.pop(capacity, 0)
    slots = minimum_slack(histogram, capacity)
    used = max((s[3] + (s[2] - s[1]) // s[4] for s in slots), default=0)
    own = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    if not slots:
        return own
    groups = F.array(*(F.lit(-(-histogram.get(n, 1) // ranked)) for n in range(1, capacity)))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.element_at(groups, F.col("length").cast("int"))).cast("int")
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", salt)
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = salted.withColumn("rank", F.row_number().over(inside) - F.lit(1).cast("bigint"))
    if max(histogram.values()) > ranked:
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
        bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        rows = join_checked(rows, materialize(bases), ["length", "salt"], "inner").withColumn("rank", F.col("rank") + F.col("base"))
    rows = rows.select(*pieces.columns, places(slots)("length", "rank").alias("at")).select(*pieces.columns, "at.*")
    return rows.unionByName(own) if full else rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer, capacity), capacity)
