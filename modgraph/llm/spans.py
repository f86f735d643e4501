"""Positions of regular-expression matches, with SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an int array, in blocks so that long arrays stay cheap."""

    def part(a: Column, b: Column) -> Column:
        return F.slice(a, b * BLOCK + 1, F.lit(BLOCK))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def of(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(part(a, b)))

        def inside(s: Column) -> Column:
            return F.flatten(
                F.transform(
                    blocks,
                    lambda b: let(
                        F.struct(total(F.slice(s, F.lit(1), b)).alias("before"), part(a, b).alias("own")),
                        lambda v: F.transform(v["own"], lambda x, i: v["before"] + total(F.slice(v["own"], F.lit(1), i + 1))),
                    ),
                )
            )

        return let(sums, inside)

    return let(numbers, of)


def find_spans(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value); code points, end exclusive.

    The text between matches comes from a split by the same expression, so a match starts where all before it ends.
    The expression must not match the empty string.
    """

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, regex, -1), F.length)
        lengths = F.transform(found, F.length)
        starts = let(
            F.struct(gaps.alias("g"), lengths.alias("l")),
            lambda v: running_sums(F.transform(v["l"], lambda n, i: F.get(v["g"], i) + F.when(i > 0, F.get(v["l"], i - 1)).otherwise(0))),
        )
        return let(
            starts,
            lambda s: F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("value")
                ),
            ),
        )

    none = F.array().cast(f"array<{SPAN}>")
    return let(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none),
    )


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")
