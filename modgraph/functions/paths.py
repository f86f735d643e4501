"""Column algebra of module paths: names joined by ``::``, the root being the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "::"


def segments(path: Column) -> Column:
    """The names of a path; none for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, SEPARATOR))


def joined(names: Column) -> Column:
    return F.array_join(names, SEPARATOR)


def truncated(path: Column, depth: int | None) -> Column:
    """The first ``depth`` names."""
    return path if depth is None else F.substring_index(path, SEPARATOR, depth)


def parent(path: Column) -> Column:
    names = segments(path)
    return joined(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))))


def depth_of(path: Column) -> Column:
    return F.size(segments(path))


def in_subtree(path: Column, ancestor: Column) -> Column:
    """Whether a path is the ancestor or below it; all is below the root."""
    return (ancestor == "") | (path == ancestor) | F.startswith(path, F.concat(ancestor, F.lit(SEPARATOR)))


def related(a: Column, b: Column) -> Column:
    """Whether one of two paths is the other or above it, the root being above nothing but itself."""

    def above(x: Column, y: Column) -> Column:
        return (x == y) | F.startswith(y, F.concat(x, F.lit(SEPARATOR)))

    return above(a, b) | above(b, a)


def matches(path: Column, base: Column, subtree: Column) -> Column:
    """Whether a pattern fits: its base alone, or with all below; an empty base with subtree fits everything."""
    below = F.startswith(path, F.concat(base, F.lit(SEPARATOR)))
    return F.when(base == "", subtree).otherwise((path == base) | (subtree & below))


def prefixes(path: Column) -> Column:
    """All leading parts of a path as an array, shortest first; none for the root."""
    names = segments(path)
    return F.when(F.size(names) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: joined(F.slice(names, 1, n)))
    )


def api_suffix(apis: Column) -> Column:
    """`` [A, B]``, or nothing of no names."""
    return F.when(F.size(apis) > 0, F.concat(F.lit(" ["), F.array_join(apis, ", "), F.lit("]"))).otherwise("")


def visible_from(caller: Column, scope: Column) -> Column:
    """Whether an item with a visibility scope is visible to a caller: '' to all, null to none, else below the scope."""
    return F.coalesce(in_subtree(caller, scope), F.lit(False))
