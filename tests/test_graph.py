import random

import pytest

from modgraph.errors import ModuleNotFound
from modgraph.operators import graph

EDGES = "source string, target string, apis array<string>"


def edges(spark, *pairs):
    return spark.createDataFrame([(p[0], p[1], list(p[2:])) for p in pairs], EDGES)


def components(pairs):
    """Strong components of two or more by mutual reachability."""
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    out = {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return sorted(sorted(c) for c in out if len(c) > 1)


def paths(pairs, source, target):
    if source == target:
        return [[source]]
    layer = [[source]]
    for _ in range(len(pairs) + 1):
        layer = [[*p, b] for p in layer for a, b in pairs if a == p[-1] and b not in p]
        hit = sorted(p for p in layer if p[-1] == target)
        if hit:
            return hit
    return []


def test_edges_are_truncated_and_merged(spark):
    rows = [("a::b", "c::d", "X"), ("a::b", "c::d", "X"), ("a::b", "c::d", "W"), ("a::b", "c::e", ""), ("a::b", "a::c", "Y"), ("a", "a", "Z"), ("", "c", "Q"), ("a", "", "Q")]
    df = spark.createDataFrame(rows, "source string, target string, api string")
    got = sorted((r.source, r.target, r.apis) for r in graph.edges_of(df).collect())
    assert got == [("a::b", "a::c", ["Y"]), ("a::b", "c::d", ["W", "X"]), ("a::b", "c::e", [])]
    got = sorted((r.source, r.target, r.apis) for r in graph.edges_of(df, depth=1).collect())
    assert got == [("a", "c", ["W", "X"])]
    assert [r.apis for r in graph.edges_of(df, depth=1, apis=False).collect()] == [[]]
    both = graph.merged([edges(spark, ("a", "b", "X")), edges(spark, ("a", "b", "Y"), ("b", "c"))])
    assert sorted((r.source, r.target, r.apis) for r in both.collect()) == [("a", "b", ["X", "Y"]), ("b", "c", [])]


def test_orphans_include_roots_and_lone_modules(spark):
    modules = spark.createDataFrame([("lib",), ("a",), ("b",), ("alone",)], "path string")
    got = graph.orphans(edges(spark, ("lib", "a"), ("a", "b"), ("b", "a")), modules)
    assert sorted(r.path for r in got.collect()) == ["alone", "lib"]


@pytest.mark.parametrize(("seed", "local"), [(0, 0), (1, 0), (2, 0), *((n, 100) for n in range(8))])
def test_cycles_match_brute_force(spark, seed, local):
    rng = random.Random(seed)
    n = rng.choice([4, 9, 14])
    pairs = sorted({(f"m{rng.randrange(n)}", f"m{rng.randrange(n)}") for _ in range(int(n * 1.4))})
    found = {}
    for r in graph.cycles(edges(spark, *pairs), local).collect():
        found.setdefault(r.cycle_id, []).append(r.path)
    assert [sorted(found[k]) for k in sorted(found)] == components([p for p in pairs if p[0] != p[1]])


def test_a_cycle_with_a_tail(spark):
    e = edges(spark, ("alpha", "beta", "B"), ("beta", "gamma", "G"), ("gamma", "alpha", "A"), ("delta", "alpha", "A"), ("standalone", "delta", "D"))
    members = graph.cycles(e)
    assert sorted(r.path for r in members.collect()) == ["alpha", "beta", "gamma"]
    assert sorted((r.source, r.target, r.apis) for r in graph.cycle_edges(e, members).collect()) == [("alpha", "beta", ["B"]), ("beta", "gamma", ["G"]), ("gamma", "alpha", ["A"])]
    assert graph.cycles(edges(spark, ("a", "b"), ("b", "c"))).count() == 0
    assert graph.cycles(edges(spark)).count() == 0 and graph.cycles(edges(spark), 0).count() == 0


@pytest.mark.parametrize(("seed", "local"), [(0, 0), (1, 0), *((n, 100) for n in range(6))])
def test_shortest_paths_match_brute_force(spark, seed, local):
    rng = random.Random(seed)
    pairs = sorted({(f"m{rng.randrange(8)}", f"m{rng.randrange(8)}") for _ in range(16)})
    e = edges(spark, *pairs)
    for target in ("m1", "m5"):
        got = sorted(r.path for r in graph.shortest_paths(e, "m0", target, local).collect())
        assert got == paths([p for p in pairs if p[0] != p[1]], "m0", target)


def test_a_diamond_has_two_paths(spark):
    e = edges(spark, ("lib", "a"), ("lib", "b"), ("a", "leaf"), ("b", "leaf"), ("a", "x"), ("x", "leaf"))
    modules = spark.createDataFrame([(m,) for m in ("lib", "a", "b", "x", "leaf")], "path string")
    found = graph.checked_paths(e, modules, "lib", "leaf")
    assert sorted(r.path for r in found.collect()) == [["lib", "a", "leaf"], ["lib", "b", "leaf"]]
    assert [r.path for r in graph.checked_paths(e, modules, "a", "a").collect()] == [["a"]]
    assert graph.checked_paths(e, modules, "leaf", "a").count() == 0
    assert sorted(tuple(r) for r in graph.path_edges(found).collect()) == [("a", "leaf"), ("b", "leaf"), ("lib", "a"), ("lib", "b")]
    assert [tuple(r) for r in graph.path_lengths(found).collect()] == [(2, 2)]
    with pytest.raises(ModuleNotFound, match="Module not found: nonexistent"):
        graph.checked_paths(e, modules, "nonexistent", "other")


def test_numbered_over_many_ranges(spark):
    names = [f"n{i:03d}" for i in range(200)]
    rows = spark.createDataFrame([(n,) for n in random.Random(3).sample(names, 200)], "name string").repartition(7)
    got = sorted((r.place, r.name) for r in graph.numbered(rows, "name", "place").collect())
    assert got == list(zip(range(1, 201), names))


def test_exponentially_many_paths_leave_the_driver(spark, monkeypatch):
    pairs = [(a, b) for i in range(4) for a in ((f"{i}a", f"{i}b") if i else ("s",)) for b in (f"{i + 1}a", f"{i + 1}b")] + [("4a", "t"), ("4b", "t")]
    found = edges(spark, *pairs)
    monkeypatch.setattr(graph, "LOCAL_PATHS", 15)
    assert graph._local_paths(pairs, "s", "t") is None
    assert sorted(r.path for r in graph.shortest_paths(found, "s", "t").collect()) == sorted(paths(pairs, "s", "t"))
    monkeypatch.setattr(graph, "LOCAL_PATHS", 16)
    assert len(graph._local_paths(pairs, "s", "t")) == 16
