"""Helpers that the operators share: checked broadcasts, components, streaming runs, and the package's shared storage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modgraph.storage import discard, materialize, shared_dir  # noqa: F401

#: Rows and bytes below which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes; of narrow columns alone (numbers), the count tells both."""
    long = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            long.append(F.octet_length(f.name))
        elif kind == "array":
            inner = f.dataType.elementType.typeName()
            long.append(F.octet_length(F.to_json(f.name)) if inner in ("string", "binary", "array", "struct") else 8 * F.size(f.name))
    if not long:
        return df.count() <= rows
    n, size = df.agg(F.count("*"), *[F.sum(sum((F.coalesce(x, F.lit(0)).cast("bigint") for x in long), F.lit(0)))]).first()
    return n <= rows and (size or 0) <= most


#: Stands for a missing id inside an operator, where ids meet by equality.
NO_ID = -(2**63)


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID).cast("bigint"))


def given_id(column: str = "doc_id") -> Column:
    """The id again, null where there was none."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Broadcast the right side where its counted rows and bytes allow, else a shuffled join that AQE may split."""
    return left.join(F.broadcast(right) if small_enough(right) else right, on, how)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def release_memory() -> None:
    """Give unused memory of a Python worker back to its machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def each_text(column: pa.Array, rows: int = 500) -> Iterator[bytes | None]:
    """The texts of a column one by one, of which Python holds few at a time."""
    for at in range(0, len(column), rows):
        yield from text_bytes(column.slice(at, rows))


def sha256_of_spans(spans: Column) -> Column:
    return F.sha2(F.array_join(spans, ","), 256)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches sorted by the key; only the last, open run is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as a spanning forest: each node that has a smaller one in its component, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), long; root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to shared storage; the number of rounds is
    logarithmic and nothing but a count and a checksum of the links reaches the driver.
    """
    links = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first())
        if now == state or not now[0]:
            break
        state = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("low")))  # read back: a hub's links can be split
        large = (
            join_checked(both, low, "a", "inner")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .distinct()
        )
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low")))
        small = join_checked(large, least, "a", "inner").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        before, links = links, materialize(small.select("e.*").where("a != b").distinct())
        discard(before, low, large, least)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


Batches = Iterator[pa.RecordBatch]
Mapper = Callable[[Batches], Batches]
