"""Removal of long repeated strings by longest-previous-factor arrays over a distributed, sparse suffix order.

A string of ``length`` bytes is a window. Every window has one anchor: the leftmost of its GRAM-byte grams with the
smallest hash. The choice looks at the window alone, so equal windows have equal anchors at equal places, and only
windows of one anchor can be equal. The windows of an anchor at one place of a text are neighbours; together they span
its context.

1. One pass over the texts gives each anchor's hash and the hash of its context. Contexts that are equal are counted,
   not compared: all their windows repeat, however many copies there are.
2. Only anchors with two or more different contexts need text. One context of each kind is fetched, and those of an anchor
   are put into suffix order column by column from the right (the order at a column follows from that at the next one
   by a stable sort of one byte), together with the longest common prefixes of neighbours. In that order the previous and
   the next smaller text positions of a suffix give its longest previous factor: where it reaches ``length``, the window
   occurs earlier. The previous and the next larger positions say the same of later places. Where first copies stay
   only the former go, else both.
3. Anchors with more kinds of contexts than ``most_contexts`` are resolved without meeting in one task: their windows are
   hashed and counted in groups.

Removing later copies keeps the first of each string (by doc_id, then place); removing all takes out every copy.

Passages are reported beside that, in words, since a run of over 50 short words can be shorter than a window of bytes:
of every run of ``passage`` words the string of PASSAGE_GRAM words with the smallest hash is marked, so two documents that
share such a run share a mark. ``n_passage_words`` counts the words of a document under marks that another document has:
more than zero for each repeated run of ``passage`` words, zero where no PASSAGE_GRAM words in a row repeat. Words are
parted by ASCII white space. The count removes nothing.

Defined results: a null text is empty; texts shorter than a window are kept whole; rows that repeat an id and text are
copies of each other, and where first copies stay such rows stay or go alike; rows
without an id come before all others; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import Batches, Mapper, discard, each_text, given_id, known_id, materialize, runs, text_bytes

LENGTH, GRAM = 400, 48
PASSAGE, PASSAGE_GRAM = 50, 35
BUFFER = 1 << 20
PLACE_BITS = 21
SPACE = re.compile(rb"[\t-\r ]")
MOST_CONTEXTS = 4096
PAD = 256
OCCURRENCE = "anchor bigint, ctx bigint, doc_id bigint, key bigint, pos bigint, lo int, wins int"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _powers(bits: int) -> list[np.uint64]:
    out = [int(FACTOR) | 1]
    for _ in range(bits):
        out.append(out[-1] ** 2 % 2**64)
    return [np.uint64(x) for x in out]


POWERS = _powers(12)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes, by doubling."""
    level = (data.astype(np.uint64) + np.uint64(1)) * FACTOR
    level ^= level >> np.uint64(31)
    out, taken, width, k = None, 0, 1, 0
    while True:
        if size & width:
            part = level[taken:]
            out = part.copy() if out is None else out[: len(part)] * POWERS[k] + part[: len(out)]
            taken += width
        if taken == size:
            break
        level = level[:-width] * POWERS[k] + level[width:]
        width, k = width * 2, k + 1
    out ^= out >> np.uint64(33)
    out *= FACTOR
    return out ^ (out >> np.uint64(29))


def window_anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each window, and the gram hashes. The data has at most 2**PLACE_BITS bytes, or words."""
    gram = min(gram, length)
    hashes = gram_hashes(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), hashes


def find_anchors(length: int) -> Mapper:
    """Over rows (doc_id, key, text): rows OCCURRENCE, one per anchor and text place."""

    def emit(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """parts: (doc_id, key, place in the text, bytes), together at most a buffer."""
        buffer = b"".join(p[3] for p in parts)
        places, hashes = window_anchors(np.frombuffer(buffer, np.uint8), length)
        sizes = np.array([len(p[3]) for p in parts])
        starts = np.cumsum(sizes) - sizes
        change = np.zeros(len(places) + 1, bool)
        change[0] = change[-1] = True
        change[1:-1] = places[1:] != places[:-1]
        change[starts] = True
        ends = starts + sizes - length + 1  # windows that cross into the next part begin here
        change[ends[ends < len(change)]] = True
        cuts = np.flatnonzero(change)
        owner = np.searchsorted(starts, cuts[:-1], side="right") - 1
        real = cuts[:-1] < ends[owner]
        first, last, owner = cuts[:-1][real], cuts[1:][real], owner[real]
        anchor = places[first]
        digest = xxhash.xxh64_intdigest
        ctx = np.fromiter((digest(buffer[a : b + length - 1]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
        ids = np.array([p[:3] for p in parts], np.int64).reshape(-1, 3)[owner]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[anchor].view(np.int64)),
                pa.array(ctx.view(np.int64)),
                pa.array(ids[:, 0]),
                pa.array(ids[:, 1]),
                pa.array(anchor - starts[owner] + ids[:, 2]),
                pa.array((anchor - first).astype(np.int32)),
                pa.array((last - first).astype(np.int32)),
            ],
            ["anchor", "ctx", "doc_id", "key", "pos", "lo", "wins"],
        )

    def find(batches: Batches) -> Batches:
        for batch in batches:
            parts, held = [], 0
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                if text is None or len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, BUFFER - length + 1):
                    piece = text[at : at + BUFFER]
                    if held + len(piece) > BUFFER and parts:
                        yield emit(parts)
                        parts, held = [], 0
                    parts.append((doc, key, at, piece))
                    held += len(piece)
            if parts:
                yield emit(parts)

    return find


# ---- passages of words


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word, from parts of a text that end between words."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        space = SPACE.search(text, at + BUFFER)
        end = space.start() if space else len(text)
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, text[at:end].split()), np.uint64))
        at = end
    return np.concatenate(out)


def find_marks(passage: int) -> Mapper:
    """Over rows (doc, text): rows (mark, doc, pos) of the marked strings of words."""

    def find(batches: Batches) -> Batches:
        step = BUFFER - passage + 1
        for batch in batches:
            held: list[tuple[np.ndarray, int, np.ndarray]] = []
            for doc, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                words = word_hashes(text or b"")
                for at in range(0, len(words) - passage + 1, step):
                    places, hashes = window_anchors(words[at : at + BUFFER], passage, PASSAGE_GRAM)
                    places = np.unique(places)
                    held.append((hashes[places], doc, places + at))
            if held:
                sizes = [len(h[0]) for h in held]
                columns = [np.concatenate([h[0] for h in held]).view(np.int64), np.repeat([h[1] for h in held], sizes), np.concatenate([h[2] for h in held]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mark", "doc", "pos"])

    return find


def passage_words(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(doc, n_passage_words) of documents that share a mark with another; narrow rows alone are shuffled.

    Whether a mark has two documents is told by the least and the greatest, so a mark that everything holds is
    aggregated before it is shuffled.
    """
    doc = F.xxhash64(known_id(), F.xxhash64("text"))
    marks = materialize(docs.where("text is not null").select(doc.alias("doc"), "text").mapInArrow(find_marks(passage), "mark bigint, doc bigint, pos int"))
    shared = marks.groupBy("mark").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("mark")
    shared = materialize(shared)  # read back, so that a partition with a common mark can be split
    at = marks.join(shared, "mark", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gram = F.lit(min(PASSAGE_GRAM, passage))
    steps = F.transform("at", lambda x, i: F.least(gram, F.coalesce(F.get("at", i + 1) - x, gram)))
    found = materialize(at.select("doc", F.aggregate(steps, F.lit(0), lambda x, y: x + y).cast("bigint").alias("n_passage_words")))
    discard(marks, shared)
    return found


# ---- suffix order of the contexts of an anchor


def nearest_smaller(value: np.ndarray, run: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or after (1) it in its run with a smaller value, or -1."""
    n = len(value)
    at = np.arange(n) + step
    inside = (at >= 0) & (at < n)
    at = np.where(inside, at, -1)
    at[(at >= 0) & (run[at] != run)] = -1
    while True:
        bad = (at >= 0) & (value[at] > value)
        if not bad.any():
            return at
        at[bad] = at[at[bad]]


def repeated_windows(contexts: list[bytes], group: np.ndarray, lo: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over (context, place of the window): it occurs at an earlier, and at a later, text position.

    In suffix order the longest match of a window at a smaller position is with its previous or next smaller value, the
    one at a larger position with its previous or next larger value; both are sought among neighbours whose common
    prefix reaches the length.

    group: ascending numbers below 128 of the anchors; position: the contexts' order in the corpus, without ties
    within a group. Context bytes are put under each other by their anchors.
    """
    sizes = np.array([len(c) for c in contexts])
    left = int(lo.max())
    width = left + int((sizes - lo).max())
    n = len(contexts)
    matrix = np.full((width, n), PAD, np.uint16)  # a row per column of text, for contiguous steps
    for i, c in enumerate(contexts):
        at = left - int(lo[i])
        matrix[at : at + len(c), i] = np.frombuffer(c, np.uint8)
    base = group.astype(np.uint16) << np.uint16(9)
    order, prefix = np.arange(n), np.zeros(n, np.int32)
    earlier, later = np.zeros((n, width), bool), np.zeros((n, width), bool)
    for c in range(width - 1, -1, -1):
        key = (base | matrix[c])[order]
        if (key[1:] < key[:-1]).any():
            place = np.argsort(key, kind="stable")
            key = key[place]
            same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & np.uint16(511) != PAD)) + 1
            new = np.zeros(n, np.int32)
            if len(same):
                spans = np.stack([place[same - 1] + 1, place[same] + 1], axis=1).ravel()
                new[same] = np.minimum.reduceat(np.append(prefix, np.int32(0)), spans)[::2] + 1
            order, prefix = order[place], new
        else:
            same = (key[1:] == key[:-1]) & (key[1:] & np.uint16(511) != PAD)
            prefix[1:] = np.where(same, prefix[1:] + 1, 0)
        if width - c >= length and (prefix >= length).any():
            linked = prefix >= length
            member = linked.copy()
            member[:-1] |= linked[1:]
            at = np.flatnonzero(member)  # neighbours in suffix order that agree in a whole window stand in one run
            run, value = np.cumsum(~linked)[at], position[order[at]]
            earlier[order[at], c] = has_nearest(value, run)
            later[order[at], c] = has_nearest(-value, run)
    return earlier, later


def has_nearest(value: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether there is a smaller value in the same run, before or after."""
    return (nearest_smaller(value, run, -1) >= 0) | (nearest_smaller(value, run, 1) >= 0)


def intervals(mask: np.ndarray) -> np.ndarray:
    """Flat (start, end) of the true runs of a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.astype(np.int32)


def resolve_contexts(length: int) -> Mapper:
    """Over rows (anchor, ctx, lo, wins, doc_id, pos, bytes) sorted by anchor: (anchor, ctx, lo, wins, earlier, other).

    The two lists hold starts and ends, flat, of the windows of the context that repeat, from 0 at its first window.
    """

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        numbers: dict[int, int] = {}
        group = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows])
        lo = np.array([r[2] for r in rows])
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort(([r[5] for r in rows], [r[4] for r in rows]))] = np.arange(len(rows))
        earlier, later = repeated_windows([r[6] for r in rows], group, lo, rank, length)
        left = int(lo.max())
        cut = lambda mask: [intervals(mask[i, left - r[2] : left - r[2] + r[3]]) for i, r in enumerate(rows)]
        names = ["anchor", "ctx", "lo", "wins", "earlier", "other"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = [[r[i] for r in rows] for i in range(4)] + [cut(earlier), cut(earlier | later)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def resolve(batches: Batches) -> Batches:
        held: list[tuple] = []
        groups = 0
        for table in runs(batches, "anchor"):
            columns = [table[c].to_pylist() for c in ("anchor", "ctx", "lo", "wins", "doc_id", "pos", "bytes")]
            group: list[tuple] = []
            for row in [*zip(*columns), None]:
                if group and (row is None or row[0] != group[0][0]):
                    if held and (groups == 127 or len(held) + len(group) > 2048):
                        yield emit(held)
                        held, groups = [], 0
                    held, groups, group = held + group, groups + 1, []
                if row is not None:
                    group.append(row)
        if held:
            yield emit(held)

    return resolve


def hashed_windows(length: int) -> Mapper:
    """Over rows (anchor, ctx, lo, wins, bytes): a row per window, (anchor, ctx, lo, wins, w, h1, h2)."""

    def explode(batches: Batches) -> Batches:
        for batch in batches:
            for anchor, ctx, lo, wins, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ctx", "lo", "wins", "bytes"))):
                both = [xxhash.xxh128_intdigest(data[i : i + length]) for i in range(wins)]
                halves = np.array([(h >> 64, h & (1 << 64) - 1) for h in both], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(wins, anchor)), pa.array(np.full(wins, ctx)), pa.array(np.full(wins, lo, np.int32)), pa.array(np.full(wins, wins, np.int32)), pa.array(np.arange(wins, dtype=np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["anchor", "ctx", "lo", "wins", "w", "h1", "h2"],
                )

    return explode


CONTEXT_KEY = ["anchor", "ctx", "lo", "wins"]
RESOLVED = "anchor bigint, ctx bigint, lo int, wins int, earlier array<int>, other array<int>"


def _resolve_large(contexts: DataFrame, length: int) -> DataFrame:
    """RESOLVED rows of contexts of which an anchor has too many for one task."""
    windows = contexts.select(*CONTEXT_KEY, "bytes").mapInArrow(
        hashed_windows(length), "anchor bigint, ctx bigint, lo int, wins int, w int, h1 bigint, h2 bigint"
    )
    windows = materialize(
        windows.join(contexts.select(*CONTEXT_KEY, F.struct("doc_id", "pos").alias("at")), CONTEXT_KEY).select(
            *CONTEXT_KEY, "w", "h1", "h2", F.struct("at.doc_id", (F.col("at.pos") - F.col("lo") + F.col("w")).alias("pos")).alias("at")
        )
    )
    counts = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    hit = windows.join(materialize(counts), ["h1", "h2"])
    flat = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("w"))))
    found = hit.groupBy(*CONTEXT_KEY).agg(flat(F.col("at") != F.col("first")).alias("earlier"), flat(F.lit(True)).alias("other"))
    pairs = lambda c: F.flatten(F.transform(c, lambda w: F.array(w, w + 1)))
    return found.select(*CONTEXT_KEY, pairs(F.col("earlier")).alias("earlier"), pairs(F.col("other")).alias("other"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, key, spans): flat starts and ends of runs of windows (their first bytes) that repeat; key is the text's hash."""
    rows = docs.select(known_id().alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    found = materialize(rows.mapInArrow(find_anchors(length), OCCURRENCE))
    kinds = materialize(
        found.groupBy(*CONTEXT_KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "key")).alias("first"))
    )
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "anchor").select(*CONTEXT_KEY, "kinds", "first.*")
    wanted = materialize(wanted)
    text = F.col("text").cast("binary")
    held = rows.join(wanted, ["doc_id", "key"]).select(
        *CONTEXT_KEY,
        "kinds",
        "doc_id",
        "pos",
        F.substring(text, (F.col("pos") - F.col("lo") + 1).cast("int"), F.col("wins") + (length - 1)).alias("bytes"),
    )
    held = materialize(held)  # rows that repeat an id and text give a context twice; it is taken once below
    small = held.where(F.col("kinds") <= most_contexts).drop("kinds").dropDuplicates(CONTEXT_KEY)
    solved = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(resolve_contexts(length), RESOLVED)
    large = held.where(F.col("kinds") > most_contexts)
    if not large.isEmpty():
        solved = solved.unionByName(_resolve_large(large.dropDuplicates(CONTEXT_KEY), length))
    solved = materialize(solved.where((F.size("other") > 0) | (F.size("earlier") > 0)))
    discard(wanted, held)
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) & (F.col("key") == F.col("first.key"))
    whole = F.array(F.lit(0), F.col("wins"))
    told = kinds.join(solved, CONTEXT_KEY, "left").where("n > 1 or other is not null")
    told = materialize(told.select(*CONTEXT_KEY, "n", "first", "earlier", "other"))
    discard(kinds, solved)
    at = found.join(told, CONTEXT_KEY)
    if keep_first:
        part = F.when(first, F.col("earlier")).otherwise(whole)
    else:
        part = F.when(F.col("n") > 1, whole).otherwise(F.col("other"))
    moved = F.transform(part, lambda w: (w + F.col("pos") - F.col("lo")))
    at = at.select("doc_id", "key", moved.alias("s")).where(F.size("s") > 0)
    spans = materialize(at.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("s")).alias("spans")))
    discard(found, told)
    return spans


def cover(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the flat spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])) if spans else []:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length - 1)
        else:
            out.append([a, b + length - 1])
    return [(a, b) for a, b in out]


REMOVED = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,kept_sha256:string>"


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep_first: bool = True, with_bytes: bool = True, most_contexts: int = MOST_CONTEXTS, passage: int | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) per row of documents; kept is null unless asked for.

    With ``passage``, also n_passage_words.
    """

    def apply(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for data, where in zip(each_text(text), spans.to_pylist()):
            data, at, parts = data or b"", 0, []
            gone = cover(where, length)
            for a, b in gone:
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            out.append((len(data), len(data) - len(kept), len(gone), kept if with_bytes else None, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = list(zip(*out)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    spans = repeated_spans(docs, length, keep_first, most_contexts)
    more = []
    if passage is not None:
        spans = spans.withColumn("doc", F.xxhash64("doc_id", "key")).join(passage_words(docs, passage), "doc", "full")
        more = [F.coalesce("n_passage_words", F.lit(0).cast("bigint")).alias("n_passage_words")]
    told = docs.select(known_id().alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    if passage is None:
        rows = told.join(spans, ["doc_id", "key"], "left")
    else:
        rows = told.withColumn("doc", F.xxhash64("doc_id", "key")).join(materialize(spans.drop("doc_id", "key")), "doc", "left")
    return rows.select("doc_id", F.arrow_udf(apply, REMOVED)("text", "spans").alias("r"), *more).select(given_id().alias("doc_id"), "r.*", *(["n_passage_words"] if more else []))


# ---- the array itself, for one text


def longest_previous_factor(text: bytes) -> list[int]:
    """For each place, the length of the longest string that starts there and also at an earlier place.

    In suffix order the best earlier match of a place is its nearest neighbour, on either side, with a smaller place.
    """
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    value = np.array(order, np.int64)
    run = np.zeros(n, np.int64)
    out = [0] * n
    for step in (-1, 1):
        near = nearest_smaller(value, run, step)
        for at, j in enumerate(near):
            if j >= 0:
                a, b, k = order[at], order[j], 0
                while a + k < n and text[a + k] == text[b + k]:
                    k += 1
                out[a] = max(out[a], k)
    return out
