"""References to modules: longest known prefix, fallback target, bare children, globs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modgraph.functions import paths as P
from modgraph.storage import checked

LIB = "lib"


def longest_prefix(refs: DataFrame, modules: DataFrame, names: str = "segments") -> DataFrame:
    """refs with ``module``, the deepest known module (column path) that leads the names, or null.

    All prefixes of a reference look the modules up in one equi-join, on distinct name lists only. The module side is
    small beside the references; it is broadcast after a check of its size.
    """
    known = checked(modules.select(F.col("path").alias("_prefix")).distinct())
    lists = refs.select(names).where(F.size(names) > 0).distinct()
    told = lists.select(names, F.posexplode(P.prefixes(P.joined(F.col(names)))).alias("_n", "_prefix"))
    best = told.join(known, "_prefix").groupBy(names).agg(F.max_by("_prefix", "_n").alias("module"))
    return refs.join(best, names, "left")


def targets(refs: DataFrame, modules: DataFrame, package: str | None = None) -> DataFrame:
    """refs (source, prefix, segments) with target and api (the names behind the module, joined; '' if none).

    A reference from the crate root, or by the package's name, that leads to no known module goes to ``lib``; other
    prefixes and empty references give no row.
    """
    rest = F.when(F.col("prefix") == "crate", F.col("segments"))
    if package is not None:
        own = (F.col("prefix") == "none") & (F.get("segments", F.lit(0)) == package)
        rest = rest.when(own, F.slice("segments", 2, F.size("segments")))
    rows = refs.where(F.size("segments") > 0).withColumn("_rest", rest).where("_rest is not null")
    found = longest_prefix(rows, modules, "_rest")
    n = F.when(F.col("module").isNull(), 0).otherwise(P.depth_of(F.col("module")))
    api = P.joined(F.slice("_rest", n + 1, F.size("_rest")))
    return found.select(*refs.columns, F.coalesce("module", F.lit(LIB)).alias("target"), api.alias("api"))


def normalise_bare(refs: DataFrame, children: DataFrame) -> DataFrame:
    """Bare references (prefix none) that start with a direct child, or a child of the root, made absolute.

    children: (parent, child). A direct child comes before a root child; other references stay as they are.
    """
    pairs = children.select("parent", "child").distinct()
    direct = checked(pairs.select(F.col("parent").alias("source"), F.col("child").alias("_first"), F.lit(True).alias("_direct")))
    root = checked(pairs.where("parent = ''").select(F.col("child").alias("_first"), F.lit(True).alias("_root")))
    first = F.when(F.col("prefix") == "none", F.get("segments", F.lit(0)))
    rows = refs.withColumn("_first", first).join(direct, ["source", "_first"], "left").join(root, "_first", "left")
    hit = F.coalesce("_direct", "_root", F.lit(False))
    moved = F.when(F.coalesce("_direct", F.lit(False)), F.concat(P.segments(F.col("source")), "segments")).otherwise(F.col("segments"))
    rows = rows.withColumn("segments", moved).withColumn("prefix", F.when(hit, "crate").otherwise(F.col("prefix")))
    return rows.select(refs.columns)


def resolve_globs(refs: DataFrame, items: DataFrame, modules: DataFrame) -> DataFrame:
    """Globs of known modules replaced by a reference to each item that the source may see.

    refs: (source, prefix, segments, glob); items: (module, name, scope), scope as in ``paths.visible_from``. A glob of
    the root or of an unknown module stays; one without a visible item goes.
    """
    target = F.when(F.col("glob") & (F.col("prefix") == "crate") & (F.size("segments") > 0), P.joined(F.col("segments")))
    rows = refs.withColumn("_target", target)
    known = checked(modules.select(F.col("path").alias("_target"), F.lit(True).alias("_known")).distinct())
    rows = rows.join(known, "_target", "left")
    stay = rows.where("_known is null").select(refs.columns)
    named = checked(items.select(F.col("module").alias("_target"), "name", "scope"))
    seen = rows.where("_known").join(named, "_target").where(P.visible_from(F.col("source"), F.col("scope")))
    seen = seen.withColumn("segments", F.concat("segments", F.array("name"))).withColumn("glob", F.lit(False))
    return stay.unionByName(seen.select(refs.columns)).distinct()


def expand_groups(refs: DataFrame) -> DataFrame:
    """References with ``leaves`` (array of structs, segments and glob among them) as one row per leaf, with its fields."""
    fields = refs.select(F.explode("leaves").alias("x")).select("x.*").columns
    rest = [c for c in refs.columns if c not in ("leaves", *fields)]
    return refs.select(*rest, F.explode("leaves").alias("_leaf")).select(*rest, "_leaf.*")
