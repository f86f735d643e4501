"""Benchmark decontamination by SimHash over item-sized windows, with SQL functions alone.

Words are runs of letters and digits, lower-cased; shingles have five words (an item of fewer words is one shingle).
Windows are as long as an item. One that shares no shingle with an item of its length has similarity zero, so windows
are taken wherever a shingle of the benchmark, broadcast after a check of their number, puts an item beside the text, with
no least number of shared shingles. (Fingerprints of every window of every length would cost some 64 additions for each
of its shingles in SQL functions; that is thousands of CPU seconds a GB.) Each window gets a 64-bit SimHash of its
shingles. A multi-index over items of the same length finds all fingerprints within the radius: the 64 bits are cut into
blocks, and fingerprints at most ``radius`` bits apart differ by at most radius // blocks bits in some block, so every
item is listed under all values that near in every block. Pairs within the radius are verified by the exact weighted
Jaccard similarity of shingles, a shingle weighing as often as it occurs. What the radius itself loses is measured by the
tests against all windows.

Defined results: null and empty texts hold nothing; an item without words is in nothing; a document shorter than an item
is one window; rows that repeat an id and text count once; other columns are carried by ``clean_documents`` alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import given_id, join_checked, known_id, materialize
from modgraph.llm.spans import let

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
MOST_SHINGLES, SALTS = 2_000_000, 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str, size: int) -> Column:
    """Hashes of the shingles of an array column of words; of the whole where it is shorter; none of no words."""
    w = F.col(words)
    some = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) > size, some).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)


def simhash_of(shingles: str) -> Column:
    """A fingerprint whose bits are those set in over half of an array column of hashes."""
    return F.expr(
        f"""aggregate(sequence(0, 63), 0L, (f, b) -> f | if(
        2 * aggregate({shingles}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size({shingles}), shiftleft(1L, b), 0L))"""
    )


def overlap(a: Column, b: Column) -> Column:
    """The sum over shingles of the smaller of their counts in two arrays."""

    def times(x: Column, of: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))


def block_values(fingerprint: str, radius: int, blocks: int, near: bool) -> Column:
    """(block, value) structs of a fingerprint; with near, all values that differ by at most radius // blocks bits."""
    width = 64 // blocks
    most = radius // blocks if near else 0
    masks = [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]
    out = []
    for k in range(blocks):
        value = F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        out.append(
            F.transform(
                F.array(*map(F.lit, masks)),
                _near(k, value),
            )
        )
    return F.concat(*out)


def _near(block: int, value: Column):
    return lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value"))


def listed_shingles(words: str, sizes: list[int]) -> Column:
    """An array of (pos, h, size) of all shingles of some sizes."""
    return F.concat(
        *(F.transform(shingles_of(words, size), _placed(size)) for size in sizes)
    )


def _placed(size: int):
    return lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(size).alias("size"))


def windows_of(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, n, start) of the item-sized windows that can resemble an item: they share a shingle with one.

    A shared shingle puts its item beside the text, and the window is what lies under it; every such place counts.
    """
    listed = items.select("n", F.least("n", F.lit(SHINGLE)).alias("size"), F.posexplode("t").alias("ipos", "h"))
    listed = listed.groupBy("h", "size", "n", "ipos").agg(F.count("*").alias("c")).drop("c")
    total, *_ = items.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    if not sizes:
        return words.select("doc_id", "key", F.lit(0).alias("n"), F.lit(0).alias("start")).limit(0)
    if len(sizes) == 1:
        told = words.select("doc_id", "key", F.posexplode(shingles_of("w", sizes[0])).alias("pos", "h"), F.lit(sizes[0]).alias("size"))
    else:
        told = words.select("doc_id", "key", F.explode(listed_shingles("w", sizes)).alias("s")).select("doc_id", "key", "s.*")
    on = ["h", "size"]
    if total <= MOST_SHINGLES:
        listed = F.broadcast(listed)
    else:  # a shingle of a common line meets its items in many tasks
        told = told.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "pos"), F.lit(SALTS)))
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on = [*on, "salt"]
    start = F.greatest(F.col("pos") - F.col("ipos"), F.lit(0))
    return told.join(listed, on).select("doc_id", "key", "n", start.alias("start")).distinct()


def contained_items(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(doc_id, key, item_id, start_word, n_words, distance, similarity): the best window of each document and item.

    key tells texts of one id apart; start_word counts from 0.
    """
    if radius // blocks >= 64 // blocks:
        raise ValueError("the radius leaves nothing to index")
    items = benchmark.select(known_id("item_id").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("n"), shingles_of("w", SHINGLE).alias("t"))
    items = materialize(items.select("*", simhash_of("t").alias("g")))
    rows = docs.select(known_id().alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    windows = windows_of(rows.select("doc_id", "key", words_of(F.col("text")).alias("w")), items)
    windows = materialize(windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("n", "start")).alias("at")))
    held = join_checked(rows, windows, ["doc_id", "key"], "inner").dropDuplicates(["doc_id", "key"])
    # the words go to a block of windows at a time, and from there only the windows go on
    blocks_of = F.transform(F.sequence(F.lit(0), F.floor((F.size("at") - 1) / 256).cast("int")), lambda b: F.slice("at", b * 256 + 1, F.lit(256)))
    held = held.select("doc_id", "key", words_of(F.col("text")).alias("w"), F.explode(blocks_of).alias("at"))
    piece = lambda a: F.struct(a["n"].alias("n"), a["start"].alias("start"), F.slice("w", a["start"] + 1, a["n"]).alias("v"))
    cut = held.select("doc_id", "key", F.explode(F.transform("at", piece)).alias("a")).select("doc_id", "key", "a.*")
    cut = cut.select("doc_id", "key", "n", "start", F.size("v").alias("size"), shingles_of("v", SHINGLE).alias("s"))
    cut = materialize(cut.select("*", simhash_of("s").alias("f")))
    # the pairs are found by fingerprints alone; hashes of shingles join them afterwards
    probes = cut.select("doc_id", "key", "n", "start", "f", F.explode(block_values("f", radius, blocks, False)).alias("b"))
    entries = items.select("item_id", "n", "g", F.explode(block_values("g", radius, blocks, True)).alias("b"))
    near = join_checked(
        probes.select("doc_id", "key", "n", "start", "f", "b.block", "b.value"),
        materialize(entries.select("item_id", "n", "g", "b.block", "b.value")),
        ["n", "block", "value"],
        "inner",
    )
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("distance")
    near = near.select("doc_id", "key", "n", "start", "item_id", distance).where(F.col("distance") <= radius).distinct()
    pairs = near.join(cut.select("doc_id", "key", "n", "start", "size", "s"), ["doc_id", "key", "n", "start"])
    pairs = join_checked(pairs, items.select("item_id", "t"), "item_id", "inner")
    shared = let(overlap(F.col("s"), F.col("t")), lambda c: c / (F.size("s") + F.size("t") - c))
    found = pairs.select("doc_id", "key", "item_id", F.struct(shared.alias("similarity"), (-F.col("start")).alias("s"), "size", "distance").alias("best"))
    found = found.where(F.col("best.similarity") >= similarity).groupBy("doc_id", "key", "item_id").agg(F.max("best").alias("best"))
    return found.select(
        given_id().alias("doc_id"),
        "key",
        given_id("item_id").alias("item_id"),
        (-F.col("best.s")).cast("bigint").alias("start_word"),
        F.col("best.size").cast("bigint").alias("n_words"),
        F.col("best.distance").cast("bigint").alias("distance"),
        F.col("best.similarity").alias("similarity"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    found = contained_items(docs, benchmark).select(known_id().alias("_id"), F.col("key").alias("_key")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, known_id().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    return join_checked(rows, materialize(found), ["_id", "_key"], "left_anti").select("_row.*")
