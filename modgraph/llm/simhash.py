"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits, from the XXH64 values of word shingles. Distinct fingerprints are dealt into tiles by
population counts and every pair of tiles is compared in full with numpy exclusive-or and bit counts, except pairs of
tiles whose population counts differ by more than the radius, which cannot hold a link:

* for a small radius a tile is one vector of population counts of ``blocks`` equal slices of the fingerprint, and two
  tiles can hold a link only where the vectors differ by at most the radius in sum. A row visits the neighbouring tiles
  on one side, so each pair of rows meets once. More slices for more rows keep tiles small;
* for a larger radius a tile is one population count, split by a hash into parts when it has many rows; the number of
  parts does not grow with the input beyond a constant, so the rows shuffled stay proportional to it.

A tile sends back its links as a spanning forest, so a group of thousands of near copies costs thousands of rows, not
millions; components join the forests. Equal fingerprints count once however many rows have them.

Defined results: a null text and a text without words have the fingerprint zero and link like any other; rows that
repeat a doc_id share its component; rows without an id have the component of their fingerprint, and are no near copies of
anything; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import NO_ID, Batches, Mapper, components, discard, each_text, join_checked, known_id, materialize, release_memory, runs, span, text_bytes

SEED = 42
#: Largest radius for tiles by sliced population counts; beyond it too many tiles are neighbours.
SLICED_RADIUS = 3
#: Near copies of at most so many bits come together before they meet by shingles.
TIGHT_RADIUS = 2
EDGE_TYPE = "a bigint, b bigint"


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of A-Z lower-cased words; of the whole sequence where it is shorter."""
    got = text.lower().split() if text else []
    if not got:
        return np.empty(0, np.uint64)
    if len(got) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(got), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(got[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(got) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit form of the bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other bits for the same shingles, by a 64-bit finalizer."""
    h = hashes ^ (hashes >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint_udf(words: int):
    def udf(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in each_text(text)], pa.int64())

    return F.arrow_udf(udf, "bigint")


def wide_fingerprint_udf(words: int):
    """Fingerprints of twice 64 bits."""

    def udf(text: pa.Array) -> pa.Array:
        first, second = [], []
        for t in each_text(text):
            h = shingle_hashes(t, words)
            first.append(majority(h))
            second.append(majority(mixed(h)))
        return pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["fp", "more"])

    return F.arrow_udf(udf, "struct<fp:bigint,more:bigint>")


class Tile(NamedTuple):
    """Fingerprints, what stands for each in links, and perhaps more bits of each."""

    fp: np.ndarray
    id: np.ndarray
    more: np.ndarray | None = None

    def part(self, lo: int, hi: int) -> Tile:
        return Tile(self.fp[lo:hi], self.id[lo:hi], None if self.more is None else self.more[lo:hi])


def close_pairs(
    left: Tile, right: Tile | None, radius: int, wide_radius: int = 0, height: int = 32, width: int = 2048
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles, or inside one where right is None, in blocks that fit the processor's cache.

    Where tiles have more bits, a pair must also be at most wide_radius bits apart over all of them.
    """
    found: list[np.ndarray] = []
    waiting = 0
    other = left if right is None else right
    space, bits = np.empty((height, width), np.uint64), np.empty((height, width), np.uint8)
    for i in range(0, len(left.fp), height):
        a = left.fp[i : i + height]
        for j in range(i if right is None else 0, len(other.fp), width):
            b = other.fp[j : j + width]
            apart = np.bitwise_xor(a[:, None], b[None, :], out=space[: len(a), : len(b)])
            count = np.bitwise_count(apart, out=bits[: len(a), : len(b)])
            if right is not None and count.min() > radius:
                continue
            x, y = np.nonzero(count <= radius)
            if right is None:
                later = x + i < y + j
                x, y = x[later], y[later]
            if left.more is not None and len(x):
                rest = np.bitwise_count(left.more[x + i] ^ other.more[y + j])
                near = count[x, y] + rest <= wide_radius
                x, y = x[near], y[near]
            if len(x):
                found.append(np.stack([left.id[x + i], other.id[y + j]]))
                waiting += len(x)
                if waiting > 500_000:
                    found = [np.stack(span(*np.concatenate(found, axis=1)))]
                    waiting = found[0].shape[1]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return span(*np.concatenate(found, axis=1))


def compare_tiles(radius: int, wide_radius: int = 0) -> Mapper:
    """Over rows (tile, side, fp, id and perhaps more) sorted by tile: side 0 is at home in the tile, side 1 visits it."""

    def compare(batches: Batches) -> Batches:
        for table in runs(batches, "tile"):
            tile, side = table["tile"].to_numpy(), table["side"].to_numpy()
            more = table["more"].to_numpy().view(np.uint64) if "more" in table.column_names else None
            rows = Tile(table["fp"].to_numpy().view(np.uint64), table["id"].to_numpy(), more)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2 or side[lo]:  # within a tile the rows at home come first
                    continue
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                home = rows.part(lo, mid)
                parts = [close_pairs(home, None, radius, wide_radius)] if mid - lo > 1 and tile[lo] >= 0 else []
                if mid < hi:
                    parts.append(close_pairs(home, rows.part(mid, hi), radius, wide_radius))
                for a, b in parts:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return compare


def _sliced(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows dealt to the tiles of sliced population counts that they are at home in or visit."""
    width = 64 // blocks
    mask = (1 << width) - 1
    base = 128  # above any count plus the radius, so that vectors read as digits do not carry
    digits = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))).cast("bigint") + radius for i in range(blocks)]
    own = reduce(lambda x, y: x * base + y, digits[1:], digits[0]) if base**blocks < 2**63 else F.xxhash64(*digits)
    steps = [()]
    for _ in range(blocks):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    ahead = [s for s in steps if s > (0,) * blocks]
    if base**blocks < 2**63:
        moves = [sum(d * base ** (blocks - 1 - i) for i, d in enumerate(s)) for s in ahead]
        visits: list[Column] = [F.col("own") + m for m in moves]
        fps = fps.withColumn("own", own)
    else:
        fps = fps.withColumn("own", own)
        visits = [F.xxhash64(*(d + F.lit(m) for d, m in zip(digits, s))).bitwiseAND(F.lit(2**63 - 1)) for s in ahead]
        fps = fps.withColumn("own", F.col("own").bitwiseAND(F.lit(2**63 - 1)))
    own = [c for c in fps.columns if c != "own"]
    return fps.select(
        *own,
        F.explode(
            F.array(
                F.struct(F.col("own").alias("tile"), F.lit(0).alias("side")),
                *(F.struct(v.alias("tile"), F.lit(1).alias("side")) for v in visits),
            )
        ).alias("t"),
    ).select("t.tile", "t.side", *own)


def _counted(fps: DataFrame, radius: int, rows: int, tile_rows: int) -> DataFrame:
    """Rows dealt to pairs of tiles by whole population count; at most 65 counts reach the driver."""
    tile_rows = max(tile_rows, rows // 64)
    counts = dict(fps.groupBy(F.bit_count("fp").alias("n")).count().collect())
    parts = {n: -(-c // tile_rows) for n, c in counts.items()} or {0: 1}
    tiles = [(n, s) for n in sorted(parts) for s in range(parts[n])]
    pairs = [(i, j) for i, (n, _) in enumerate(tiles) for j, (m, _) in enumerate(tiles) if i <= j and m - n <= radius]
    rows_of: list[tuple] = []
    for k, (i, j) in enumerate(pairs):
        # a negative number marks a pair of different tiles: there only home meets visitor
        key = k + 1 if i == j else -(k + 1)
        rows_of.append((*tiles[i], key, 0))
        if i != j:
            rows_of.append((*tiles[j], key, 1))
    plan = fps.sparkSession.createDataFrame(rows_of, "n int, s int, tile bigint, side int")
    part = F.create_map(*(F.lit(x) for n, m in parts.items() for x in (n, m)))
    n = F.bit_count("fp")
    return (
        fps.select(*fps.columns, n.alias("n"), F.pmod(F.xxhash64("fp"), part[n]).cast("int").alias("s"))
        .join(F.broadcast(plan), ["n", "s"])
        .select("tile", "side", *fps.columns)
    )


def fingerprint_links(fps: DataFrame, radius: int, wide_radius: int = 0, tile_rows: int = 32_768) -> DataFrame:
    """Spanning links (a, b) of ids of fingerprints (fp, id and perhaps more, long) at most radius bits apart."""
    rows = fps.count()
    if radius <= SLICED_RADIUS:
        dealt = _sliced(fps, radius, 4 if rows < 50_000_000 else 8 if rows < 5_000_000_000 else 16)
    else:
        dealt = _counted(fps, radius, rows, tile_rows)
    return dealt.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(compare_tiles(radius, wide_radius), EDGE_TYPE)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over fingerprints at most radius bits apart."""
    prints = materialize(docs.select("doc_id", fingerprint_udf(words)("text").alias("fp")))
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(first.select("fp", F.col("fp").alias("id")), radius))
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"))
    return join_checked(prints, named, "fp", "left").select("doc_id", "fp", "component_id")


# ---- near copies by verified similarity, over the same tiles


def verify_tiles(similarity: float) -> Mapper:
    """Over rows (tile, side, rep, hashes) sorted by tile: spanning links of pairs with Jaccard >= similarity."""

    def verify(batches: Batches) -> Batches:
        for table in runs(batches, "tile"):
            tile, side = table["tile"].to_numpy(), table["side"].to_numpy()
            rep = table["rep"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(x, np.int64) for x in table["hashes"].slice(lo, hi - lo).to_pylist()]
                a, b = similar(sets, int(np.searchsorted(side[lo:hi], 1)), similarity)
                if len(a):
                    x, y = span(rep[lo + a], rep[lo + b])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        release_memory()

    return verify


def similar(sets: list[np.ndarray], home: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with Jaccard >= similarity; the first ``home`` sets meet each other and the rest.

    Postings of each shingle give a row of exact overlaps at once, so no pair of sets is intersected by itself.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    posting, start = owner[order], np.searchsorted(value[order], np.arange(value.max() + 2))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a, b = [], []
    for i in range(home):
        mine = value[ends[i] : ends[i + 1]]
        shared = np.bincount(np.concatenate([posting[start[v] : start[v + 1]] for v in mine]), minlength=len(sets))
        hit = np.flatnonzero(shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
        hit = hit[hit > i]
        a.append(np.full(len(hit), i))
        b.append(hit)
    return np.concatenate(a or [np.empty(0, int)]), np.concatenate(b or [np.empty(0, int)])


def shingle_sets(words: int) -> Mapper:
    """Over rows (rep, root, size, text): (rep, root, size, hashes), few rows at a time; texts without words are left out."""

    def sets(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.unique(shingle_hashes(t, words)).tobytes() for t in text_bytes(part.column("text"))]
                kept = pa.array([bool(x) for x in found], pa.bool_())
                out = pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("root"), part.column("size"), pa.array(found, pa.binary())], ["rep", "root", "size", "hashes"]
                )
                yield out.filter(kept)
        release_memory()

    return sets


# ---- the pairs that fingerprints do not bring together, by shared rare shingles

#: Texts whose shingles tell which are common, and the most common shingles told; both only set an order.
ORDER_TEXTS = 20_000
ORDER_SHINGLES = 200_000
RARE_NAMES = ["token", "id", "part", "fp", "more", "n", "place"]
#: Tiles of at most SMALL_TILE rows are compared pair by pair, many at once; a shingle's tile has about HOT_TILE rows at most.
SMALL_TILE, HOT_TILE = 32, 20_000


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set of a size shares with any other of the similarity, at least."""
    return max(1, math.ceil(similarity * size - 1e-9))


def sampled_shingles(words: int) -> Mapper:
    """Over rows (node, part, text): the distinct shingles of each text and its part."""

    def shingles(batches: Batches) -> Batches:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for at, text in enumerate(each_text(batch.column("text"))):
                found = np.unique(shingle_hashes(text, words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), parts[at]))], ["token", "part"])
        release_memory()

    return shingles


def rare_shingles(words: int, similarity: float, common: np.ndarray, often: np.ndarray) -> Mapper:
    """Over rows (node, part, fp, more, text): the first shingles of each text in one order of all shingles, rare ones first.

    Texts of the similarity share one of them, whatever the order is: of n shingles, all but the least shared number
    less one are given. ``place`` is the shingle's place in the order.
    """

    def rare(batches: Batches) -> Batches:
        for batch in batches:
            told = [batch.column(c).to_numpy() for c in ("node", "part", "fp", "more")]
            for at in range(0, batch.num_rows, 500):
                rows = []
                for i, text in enumerate(text_bytes(batch.column("text").slice(at, 500)), at):
                    h = np.unique(shingle_hashes(text, words)).view(np.int64)
                    if not len(h):
                        continue
                    first = len(h) - least_shared(len(h), similarity) + 1
                    if len(common):
                        where = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        h = h[np.lexsort((h, np.where(common[where] == h, often[where], 0)))]
                    n = np.full(first, len(h), np.int32)
                    rows.append((h[:first], *(np.full(first, c[i]) for c in told), n, np.arange(first, dtype=np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], RARE_NAMES)
        release_memory()

    return rare


def forest(tile: Tile, part: np.ndarray, radius: int, wide_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning links (places) between the parts of a tile by fingerprints, and the component of each row.

    One open row after the other is compared with the whole tile; what is near to it needs no comparison of its own, so a
    tile of near copies takes few passes, not one a row.
    """
    open_rows = np.ones(len(part), bool)
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    a, b = [np.arange(len(part))], [first[of]]
    at = 0
    while at < len(part):
        apart = np.bitwise_count(tile.fp ^ tile.fp[at])
        near = np.flatnonzero(apart <= radius)
        near = near[apart[near] + np.bitwise_count(tile.more[near] ^ tile.more[at]) <= wide_radius]
        open_rows[near] = False
        open_rows[at] = False
        a.append(np.full(len(near), at))
        b.append(near)
        left = open_rows[at:].argmax()
        at = at + int(left) if open_rows[at + left] else len(part)
    links = np.concatenate(a), np.concatenate(b)
    component = np.arange(len(part))
    moved, least = span(*links)
    component[moved] = least
    across = part[links[0]] != part[links[1]]
    x, y = span(links[0][across], links[1][across]) if across.any() else (np.empty(0, int), np.empty(0, int))
    return x, y, component


def meetings(similarity: float, radius: int, wide_radius: int) -> Mapper:
    """Over rows of rare_shingles sorted by tile and part: (near, a, b) of rows of different parts that meet in a tile.

    near: links by fingerprints at most radius of 64 bits and wide_radius of 128 apart, a forest in large tiles. Not near:
    pairs without such a link that may have the similarity. From the first shingle that a pair shares on, the shorter rest
    of the two bounds what the pair shares; pairs that fall short at every shingle they meet at are none.
    """
    share = similarity / (1 + similarity)

    def meet(batches: Batches) -> Batches:
        for table in runs(batches, "tile"):
            tile, part, ids, n = (table[c].to_numpy() for c in ("tile", "part", "id", "n"))
            rest, n = n - table["place"].to_numpy(), n.astype(np.int64)
            prints = Tile(table["fp"].to_numpy().view(np.uint64), ids, table["more"].to_numpy().view(np.uint64))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
            changes = np.add.reduceat(np.concatenate([[0], np.diff(part) != 0]).astype(np.int64), cuts[:-1])
            changes -= np.concatenate([[0], part[cuts[1:-1]] != part[cuts[1:-1] - 1]])
            sizes = np.diff(cuts)
            near_pairs: list[tuple] = []
            listed: list[tuple] = []
            # small tiles together, by the distance of rows
            rows = np.flatnonzero(np.repeat((changes > 0) & (sizes <= SMALL_TILE), sizes))
            for step in range(1, SMALL_TILE):
                i, j = rows[:-step], rows[step:]
                same = tile[i] == tile[j]
                if not same.any():
                    break
                same &= part[i] != part[j]
                i, j = i[same], j[same]
                may = np.minimum(rest[i], rest[j]) >= share * (n[i] + n[j]) - 1e-9
                i, j = i[may], j[may]
                apart = np.bitwise_count(prints.fp[i] ^ prints.fp[j])
                near = (apart <= radius) & (apart + np.bitwise_count(prints.more[i] ^ prints.more[j]) <= wide_radius)
                near_pairs.append((ids[i[near]], ids[j[near]]))
                listed.append((ids[i[~near]], ids[j[~near]]))
            for r in np.flatnonzero((changes > 0) & (sizes > SMALL_TILE)).tolist():
                lo, hi = int(cuts[r]), int(cuts[r + 1])
                x, y, component = forest(prints.part(lo, hi), part[lo:hi], radius, wide_radius)
                near_pairs.append((ids[x + lo], ids[y + lo]))
                values, counts = np.unique(component, return_counts=True)
                if len(values) == 1:
                    continue
                largest = values[counts.argmax()]
                for i in np.flatnonzero(component != largest).tolist():
                    others = component != component[i]
                    others[:i] &= component[:i] == largest  # pairs of rows outside the largest component once
                    j = np.flatnonzero(others) + lo
                    may = np.minimum(rest[j], rest[lo + i]) >= share * (n[j] + n[lo + i]) - 1e-9
                    listed.append((np.full(int(may.sum()), ids[lo + i]), ids[j[may]]))
            # over all tiles at hand: a forest of the near, and the listed pairs that it does not connect
            if near_pairs:
                a, b = (np.concatenate(c) for c in zip(*near_pairs))
                a, b = span(a, b) if len(a) else (a, b)
                x, y = (np.concatenate(c) for c in zip(*listed)) if listed else (a[:0], a[:0])
                root = lambda v: np.where(a[np.minimum(np.searchsorted(a, v), len(a) - 1)] == v, b[np.minimum(np.searchsorted(a, v), len(a) - 1)], v)
                if len(a) and len(x):
                    open_pairs = root(x) != root(y)
                    x, y = x[open_pairs], y[open_pairs]
                x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else (x, y)
                near = np.concatenate([np.ones(len(a), bool), np.zeros(len(x), bool)])
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.concatenate([a, x])), pa.array(np.concatenate([b, y]))], ["near", "a", "b"])
        release_memory()

    return meet


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A set as bits, four or more for each of its members."""
    size = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.int64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _sketches(hashes: pa.Array) -> pa.Array:
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in hashes]
    return pa.StructArray.from_arrays([pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], ["n", "bits"])


def most_shared(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> int:
    """No fewer than the members that two sets share, by their sketches.

    Shared members stand on shared bits; more than one on a bit are among those that each set has beyond its bits.
    """
    while len(x) != len(y):  # a longer sketch folds into a shorter one
        if len(x) < len(y):
            x, y = y, x
            nx, ny = ny, nx
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    on = [int(np.bitwise_count(z).sum()) for z in (x & y, x, y)]
    return on[0] + min(nx - on[1], ny - on[2])


def possible_pairs(similarity: float) -> Mapper:
    """Over rows (a, b, nx, x, ny, y) with the sketches of a and b: the pairs that can have the similarity."""

    def possible(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for nx, x, ny, y in zip(*(batch.column(c) for c in ("nx", "x", "ny", "y"))):
                nx, ny = nx.as_py(), ny.as_py()
                shared = most_shared(np.frombuffer(x.as_buffer(), np.uint8), nx, np.frombuffer(y.as_buffer(), np.uint8), ny)
                keep.append(shared >= similarity * (nx + ny - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return possible


def verify_pairs(similarity: float) -> Mapper:
    """Over rows (a, b, x, y) with the sets of a and b: the pairs with Jaccard >= similarity."""

    def verify(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[at].as_buffer(), np.int64) for c in "xy")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def rare_meetings(texts: DataFrame, rows: int, words: int, similarity: float, radius: int, wide_radius: int) -> DataFrame:
    """(near, a, b), written: what meetings tells of texts (node, part, fp, more, text) over their rare shingles.

    Texts of the similarity share a rare shingle, so they meet in its tile. A shingle of more than HOT_TILE rows is cut
    into parts, and each pair of parts is a tile.
    """
    some = texts.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(max(1, rows // ORDER_TEXTS))) == 0)
    seen = some.mapInArrow(sampled_shingles(words), "token bigint, part bigint").groupBy("token")
    often = seen.agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("n > 2 and low < high")
    often = often.orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES)
    told = often.orderBy("token").toArrow()
    common, n = told["token"].to_numpy(), told["n"].to_numpy()
    kinds = ["bigint"] * 5 + ["int"] * 2
    rare = texts.select("node", "part", "fp", "more", "text").mapInArrow(rare_shingles(words, similarity, common, n), ", ".join(map(" ".join, zip(RARE_NAMES, kinds))))
    rare = materialize(rare)
    hot = materialize(rare.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT_TILE).select("token", F.ceil(F.col("c") / HOT_TILE).alias("m")))
    dealt = rare.withColumn("tile", F.col("token"))
    if not hot.isEmpty():
        cut = join_checked(rare, hot, "token", "inner").withColumn("s", F.pmod(F.xxhash64("id", F.lit(7)), F.col("m")))
        places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), lambda t: F.xxhash64("token", F.least(t, "s"), F.greatest(t, "s")))
        cut = cut.withColumn("tile", F.explode(places)).select(*rare.columns, "tile")
        dealt = join_checked(dealt, hot, "token", "left_anti").unionByName(cut)
    dealt = dealt.drop("token").repartition("tile").sortWithinPartitions("tile", "part")
    found = materialize(dealt.mapInArrow(meetings(similarity, radius, wide_radius), "near boolean, a bigint, b bigint").distinct())
    discard(rare, hot)
    return found


def verified_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts (node, text) that have the similarity.

    Sketches, an eighth of the sets or less, leave out most others first; they never leave out a pair that has it.
    """
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = join_checked(texts, ends, "node", "inner").select(F.col("node").alias("rep"), F.col("node").alias("root"), F.lit(1).cast("bigint").alias("size"), "text")
    sets = held.mapInArrow(shingle_sets(words), "rep bigint, root bigint, size bigint, hashes binary")
    sets = materialize(sets.select("rep", "hashes"))
    marks = materialize(sets.select("rep", F.arrow_udf(_sketches, "struct<n:int,bits:binary>")("hashes").alias("s")).select("rep", "s.*"))
    end = lambda e, n, x: marks.select(F.col("rep").alias(e), F.col("n").alias(n), F.col("bits").alias(x))
    both = join_checked(join_checked(pairs, end("a", "nx", "x"), "a", "inner"), end("b", "ny", "y"), "b", "inner")
    likely = materialize(both.select("a", "b", "nx", "x", "ny", "y").mapInArrow(possible_pairs(similarity), EDGE_TYPE))
    both = likely.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    found = materialize(both.select("a", "b", "x", "y").mapInArrow(verify_pairs(similarity), EDGE_TYPE))
    discard(ends, sets, marks, likely)
    return found


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes (node, id, key, rows): one row each, also where the same row comes again."""
    told = docs.select(known_id().alias("id"), text_key().alias("key"), "text")
    found = join_checked(told, nodes, ["id", "key"], "inner")
    once = found.where("rows = 1")
    if nodes.where("rows > 1").isEmpty():
        return once.drop("id", "key", "rows")
    return once.unionByName(found.where("rows > 1").dropDuplicates(["node"])).drop("id", "key", "rows")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def text_groups(
    docs: DataFrame, words: int, similarity: float, radius: int, wide_radius: int, tile_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, more, key) of docs, and distinct texts (fp, more, key, node, id, rows, root) with their groups.

    Each distinct text is a node of its own, whatever its ids. Its ``id`` is the smallest it has, a known one where
    there is one; ``rows`` counts the rows of that id with the text. NO_ID stands for a missing id.
    """
    prints = docs.select(known_id().alias("doc_id"), wide_fingerprint_udf(3)(F.coalesce("text", F.lit(""))).alias("p"), text_key().alias("key"))
    prints = materialize(prints.select("doc_id", "p.fp", "p.more", "key"))
    named = prints.groupBy("fp", "more", "key", "doc_id").agg(F.count("*").alias("rows"))
    least = F.min(F.struct((F.col("doc_id") == NO_ID).alias("none"), F.col("doc_id").alias("id"), "rows")).alias("first")
    texts = named.groupBy("fp", "more", "key").agg(least).select("fp", "more", "key", "first.id", "first.rows")
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()))
    tight = materialize(fingerprint_links(texts.select("fp", F.col("node").alias("id")), min(radius, TIGHT_RADIUS)))
    parts = materialize(components(tight))
    places = texts.select("node", "fp", "more", "id", "key", "rows")
    nodes = materialize(join_checked(places, parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    met = rare_meetings(texts_of(docs, nodes), nodes.count(), words, similarity, radius, wide_radius)
    roots = materialize(components(tight.unionByName(met.where("near").select("a", "b"))))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    places = texts.select("node", "id", "key", "rows")
    members = materialize(roots.join(sizes, "root").join(places, "node"))
    held = texts_of(docs, members).select(F.col("node").alias("rep"), "root", "size", "text")
    sets = materialize(held.mapInArrow(shingle_sets(words), "rep bigint, root bigint, size bigint, hashes binary"))
    m = F.ceil(F.col("size") / tile_rows)
    s = F.pmod(F.xxhash64("rep", F.lit(7)), m)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), m - 1),
        lambda t: F.struct(
            F.xxhash64("root", F.least(t, s), F.greatest(t, s)).alias("tile"), (t < s).cast("int").alias("side")
        ),
    )
    dealt = sets.select("rep", "hashes", F.explode(pairs).alias("p")).select("p.tile", "p.side", "rep", "hashes")
    links = dealt.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(verify_tiles(similarity), EDGE_TYPE)
    links = materialize(links)
    # pairs that no component holds are verified one by one
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    apart = join_checked(join_checked(met.where("not near").select("a", "b"), at("a"), "a", "left"), at("b"), "b", "left")
    apart = materialize(apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    rest = verified_pairs(apart, texts_of(docs, places), words, similarity)
    groups = materialize(components(links.unionByName(rest)))
    discard(sets, links, met, nodes, members)
    return prints, materialize(join_checked(texts, groups, "node", "left").withColumn("root", F.coalesce("root", "node")))


def near_copies(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    radius: int = 13,
    wide_radius: int = 24,
    tile_rows: int = 1024,
) -> DataFrame:
    """(doc_id, group_id): groups over texts whose sets of ``words``-word shingles have Jaccard >= similarity.

    Fingerprints of 3-word shingles are compared exactly, in tiles: first by sliced population counts for the closest,
    then in a tile for each rare shingle, in one of which texts of the similarity must meet. There fingerprints at most
    ``radius`` of 64 bits and ``wide_radius`` of 128 apart are linked, as a forest, and other pairs are listed if they can
    have the similarity. Components of links are verified exactly, in tiles of bounded size where a component is large,
    and listed pairs between components one by one, so none is missed and no step compares all with all. Texts that are
    equal count once; a text without words groups with equal texts only.
    """
    docs = docs.where("doc_id is not null")
    prints, texts = text_groups(docs, words, similarity, radius, wide_radius, tile_rows)
    least = texts.groupBy("root").agg(F.min("id").alias("group_id"))
    found = materialize(texts.join(least, "root").select("fp", "more", "key", "group_id"))
    return prints.join(found, ["fp", "more", "key"], "left").select("doc_id", "group_id")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 13, wide_radius: int = 24, tile_rows: int = 1024) -> DataFrame:
    """One row of each group of near_copies: the smallest doc_id, and of it the smallest text key.

    Rows are told by id and text, so texts that share an id are judged apart; a row without an id stays only in a group
    in which no row has one. Of rows with the same id and text one stays.
    """
    prints, texts = text_groups(docs, words, similarity, radius, wide_radius, tile_rows)
    order = F.struct((F.col("id") == NO_ID).alias("none"), "id", "key", "node")
    best = texts.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.node").alias("node"))
    stay = materialize(texts.join(best, "node").select(F.col("id").alias("near_id"), F.col("key").alias("near_key"), "rows"))
    rows = prints.select(F.col("doc_id").alias("near_id"), F.col("key").alias("near_key")).distinct()
    gone = materialize(rows.join(stay, ["near_id", "near_key"], "left_anti"))
    again = stay.where("rows > 1").drop("rows")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever the columns are called
    told = docs.select(row, known_id().alias("near_id"), text_key().alias("near_key"))
    left = join_checked(told, gone, ["near_id", "near_key"], "left_anti")
    if not again.isEmpty():
        more = join_checked(left, again, ["near_id", "near_key"], "left_semi").dropDuplicates(["near_id", "near_key"])
        left = join_checked(left, again, ["near_id", "near_key"], "left_anti").unionByName(more)
    return left.select("row.*")
