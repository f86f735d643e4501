"""The dependency graph: edges with their APIs, orphans, cycles and shortest paths, all as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modgraph.errors import ModuleNotFound
from modgraph.functions import paths as P
from modgraph.storage import discard, materialize


def edges_of(resolved: DataFrame, depth: int | None = None, apis: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, apis) of rows (source, target, api): truncated, without loops and empty ends.

    With ``by``, columns that tell several graphs in one table apart, a graph each.
    """
    rows = resolved.select(
        *by, P.truncated(F.col("source"), depth).alias("source"), P.truncated(F.col("target"), depth).alias("target"), "api"
    ).where("source <> target and source <> '' and target <> ''")
    names = F.array_sort(F.collect_set(F.when(F.col("api") != "", F.col("api")))) if apis else F.array().cast("array<string>")
    return rows.groupBy(*by, "source", "target").agg(names.alias("apis"))


def merged(graphs: list[DataFrame]) -> DataFrame:
    """The union of edge tables, with the APIs of equal edges together."""
    rows = reduce(DataFrame.unionByName, graphs).select("source", "target", F.explode_outer("apis").alias("api"))
    return rows.groupBy("source", "target").agg(F.array_sort(F.collect_set("api")).alias("apis"))


def truncated_modules(modules: DataFrame, depth: int | None = None) -> DataFrame:
    return modules.select(P.truncated(F.col("path"), depth).alias("path")).distinct()


def orphans(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that nothing depends on."""
    return modules.select("path").distinct().join(edges.select(F.col("target").alias("path")).distinct(), "path", "left_anti")


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count_distinct("target").alias("targets"))


#: Graphs of at most so many edges (a few MB of names) are walked on the driver; a job per round would cost far more.
LOCAL_EDGES = 100_000
#: Shortest paths are put together on the driver if there are at most so many; their number can be exponential.
LOCAL_PATHS = 10_000


def _pairs(edges: DataFrame) -> DataFrame:
    """The distinct edges without loops, written once: they are counted, and then read again and again."""
    return materialize(edges.select("source", "target").where("source <> target").distinct())


def _local_edges(pairs: DataFrame, most: int) -> list[tuple[str, str]] | None:
    """The edges, if they are at most so many."""
    return [(r[0], r[1]) for r in pairs.collect()] if pairs.count() <= most else None


def _local_components(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(path, component) as in ``strong_components``: nodes by the end of a walk, then walks against the edges in reverse."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)

    def walk(start: str, ways: dict[str, list[str]], seen: set[str]) -> list[str]:
        """What is newly reached from a start, each after all that is reached through it."""
        ended, open_ways = [], [(start, iter(ways.get(start, ())))]
        seen.add(start)
        while open_ways:
            node, rest = open_ways[-1]
            nxt = next((n for n in rest if n not in seen), None)
            if nxt is None:
                ended.append(node)
                open_ways.pop()
            else:
                seen.add(nxt)
                open_ways.append((nxt, iter(ways.get(nxt, ()))))
        return ended

    seen: set[str] = set()
    ended = [n for start in sorted({*ahead, *back}) if start not in seen for n in walk(start, ahead, seen)]
    seen, out = set(), []
    for start in reversed(ended):
        if start not in seen:
            part = walk(start, back, seen)
            out += [(n, min(part)) for n in part if len(part) > 1]
    return out


def _local_paths(pairs: list[tuple[str, str]], source: str, target: str) -> list[list[str]] | None:
    """All paths of fewest edges: distances to the target first, then only steps that come nearer; None if too many."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    far, layer = {target: 0}, [target]
    while layer and source not in far:
        reached = {p for n in layer for p in back.get(n, ()) if p not in far}
        far |= dict.fromkeys(reached, far[layer[0]] + 1)
        layer = sorted(reached)
    if source not in far:
        return []
    ways = {source: 1}
    for left in range(far[source] - 1, -1, -1):
        reached: dict[str, int] = {}
        for p, n in ways.items():
            for q in ahead[p]:
                if far.get(q) == left:
                    reached[q] = reached.get(q, 0) + n
        ways = reached
    if ways[target] > LOCAL_PATHS:
        return None
    paths = [[source]]
    for left in range(far[source] - 1, -1, -1):
        paths = [[*p, n] for p in paths for n in ahead[p[-1]] if far.get(n) == left]
    return paths


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when ends without both ways in and out have gone, again and again."""
    count = edges.count()
    while count:
        outs = edges.select(F.col("source").alias("target")).distinct()
        ins = edges.select(F.col("target").alias("source")).distinct()
        edges = materialize(edges.join(outs, "target", "left_semi").join(ins, "source", "left_semi").select("source", "target"))
        before, count = count, edges.count()
        if count == before:
            break
    return edges


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path, component) of modules in strongly connected components of two or more; component is the least path.

    Trimmed edges are coloured: the least name spreads forward along edges until nothing changes, then from each
    colour's own module backward within the colour. What is reached both ways is a component; it is taken out and the
    rest starts again. Every round is a join and an aggregation over the edges that are left; each is written to shared
    storage, and only counts reach the driver.
    """
    written = _pairs(edges)
    pairs = _local_edges(written, local_edges)
    if pairs is not None:
        discard(written)
        return edges.sparkSession.createDataFrame(_local_components(pairs), "path string, component string")
    left, found = _trimmed(written), None
    while left.count():
        nodes = left.select(F.explode(F.array("source", "target")).alias("path")).distinct()
        colour = materialize(nodes.select("path", F.col("path").alias("colour")))
        while True:
            reached = left.join(colour, left.source == colour.path).groupBy("target").agg(F.min("colour").alias("new"))
            moved = colour.join(reached, colour.path == reached.target, "left")
            moved = materialize(moved.select("path", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
            if not moved.where("moved").limit(1).count():
                break
            colour = moved.select("path", "colour")
        colour = moved.select("path", "colour")
        inside = left.join(colour.select(F.col("path").alias("source"), "colour"), "source")
        inside = inside.join(colour.select(F.col("path").alias("target"), "colour"), ["target", "colour"])
        inside = materialize(inside.select("source", "target", "colour"))
        seen = materialize(colour.where("path = colour"))
        frontier = seen
        while True:
            step = inside.join(frontier, (inside.target == frontier.path) & (inside.colour == frontier.colour))
            step = step.select(F.col("source").alias("path"), inside.colour).distinct()
            frontier = materialize(step.join(seen, ["path", "colour"], "left_anti"))
            if not frontier.limit(1).count():
                break
            seen = materialize(seen.unionByName(frontier))
        sizes = seen.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        part = seen.join(sizes, "colour", "left_semi").select("path", F.col("colour").alias("component"))
        found = materialize(part if found is None else found.unionByName(part))
        gone = seen.select("path")
        left = left.join(gone.select(F.col("path").alias("source")), "source", "left_anti")
        left = left.join(gone.select(F.col("path").alias("target")), "target", "left_anti")
        left = _trimmed(materialize(left.select("source", "target")))
    if found is None:
        return edges.select(F.col("source").alias("path"), F.col("target").alias("component")).limit(0)
    return found


def cycles(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(cycle_id, path): components numbered from 1 by their least module."""
    members = strong_components(edges, local_edges)
    return members.join(numbered(members.select("component").distinct(), "component", "cycle_id"), "component").select("cycle_id", "path")


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the place of each in the order of a distinct column, from 1.

    Ranges of the column are numbered each by itself; only the ranges' sizes, as many as there are partitions, are added
    up in one task.
    """
    dealt = materialize(rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + inside).cast("int").alias(name))


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cycle_id, source, target, apis): the edges inside each cycle."""
    a = members.select("cycle_id", F.col("path").alias("source"))
    b = members.select("cycle_id", F.col("path").alias("target"))
    return edges.join(a, "source").join(b, ["cycle_id", "target"]).select("cycle_id", "source", "target", "apis")


def shortest_paths(edges: DataFrame, source: str, target: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path): every path of fewest edges, as an array; just the module itself from a module to itself.

    Levels spread forward until the target is met; the paths are then put together backward over the edges between
    levels alone, so nothing but shortest paths is ever built.
    """
    spark = edges.sparkSession
    one = lambda name: spark.createDataFrame([(name, 0)], "path string, level int")
    if source == target:
        return one(source).select(F.array("path").alias("path"))
    pairs = _pairs(edges)
    few = _local_edges(pairs, local_edges)
    found = _local_paths(few, source, target) if few is not None else None
    if found is not None:
        discard(pairs)
        return spark.createDataFrame([(p,) for p in found], "path array<string>")
    seen, frontier, level = one(source), one(source), 0
    while True:
        level += 1
        step = pairs.join(frontier, pairs.source == frontier.path).select(F.col("target").alias("path")).distinct()
        frontier = materialize(step.join(seen, "path", "left_anti").select("path", F.lit(level).alias("level")))
        if not frontier.limit(1).count():
            return one(source).select(F.array("path").alias("path")).limit(0)
        seen = materialize(seen.unionByName(frontier))
        if frontier.where(F.col("path") == target).limit(1).count():
            break
    found = spark.createDataFrame([([target], target)], "path array<string>, tip string")
    for at in range(level - 1, -1, -1):
        layer = seen.where(F.col("level") == at).select(F.col("path").alias("source"))
        back = pairs.join(layer, "source", "left_semi")
        found = found.join(back, found.tip == back.target).select(
            F.concat(F.array("source"), "path").alias("path"), F.col("source").alias("tip")
        )
    return found.select("path")


def checked_paths(edges: DataFrame, modules: DataFrame, source: str, target: str) -> DataFrame:
    """``shortest_paths`` between known modules; ModuleNotFound names the first that is unknown."""
    for name in (source, target):
        if not modules.where(F.col("path") == name).limit(1).count():
            raise ModuleNotFound(name)
    return shortest_paths(edges, source, target)


def path_edges(paths: DataFrame) -> DataFrame:
    """(source, target) of consecutive modules."""
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("source"), F.slice("path", 2, F.size("path")).alias("target"))
    return paths.where(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.source", "e.target").distinct()


def truncated_paths(paths: DataFrame, depth: int | None) -> DataFrame:
    return paths.select(F.transform("path", lambda p: P.truncated(p, depth)).alias("path")).distinct()


def path_lengths(paths: DataFrame) -> DataFrame:
    return paths.groupBy((F.size("path") - 1).alias("length")).agg(F.count("*").alias("paths"))


def explain(resolved: DataFrame, source: str, target: str, recursive: bool = False) -> DataFrame:
    """The references of a module, or of all below it, that lead to a target; none if the target is unknown."""
    of = P.in_subtree(F.col("source"), F.lit(source)) if recursive else F.col("source") == source
    return resolved.where(of & (F.col("target") == target))
