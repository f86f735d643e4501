from pyspark.sql import functions as F

from modgraph.functions import paths as P
from modgraph.operators import graph, resolve

REFS = "source string, prefix string, segments array<string>"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_targets(spark):
    modules = spark.createDataFrame([("a",), ("a::b",), ("c",)], "path string")
    refs = spark.createDataFrame(
        [("m", "crate", ["a", "b", "X", "y"]), ("m", "crate", ["a", "Z"]), ("m", "crate", ["nope", "Q"]), ("m", "none", ["pkg", "c", "F"]), ("m", "none", ["pkg", "G"]), ("m", "none", ["std", "fmt"]), ("m", "crate", []), ("m", "super", ["a"])],
        REFS,
    )
    got = rows(resolve.targets(refs, modules, "pkg"), "target", "api")
    assert got == [("a", "Z"), ("a::b", "X::y"), ("c", "F"), ("lib", "G"), ("lib", "nope::Q")]
    assert rows(resolve.targets(refs, modules), "target", "api") == [("a", "Z"), ("a::b", "X::y"), ("lib", "nope::Q")]


def test_a_direct_child_comes_before_a_root_child(spark):
    children = spark.createDataFrame([("", "x"), ("", "y"), ("p", "x")], "parent string, child string")
    refs = spark.createDataFrame([("p", "none", ["x", "A"]), ("p", "none", ["y", "B"]), ("p", "none", ["z", "C"]), ("", "none", ["x", "D"]), ("p", "crate", ["x", "E"])], REFS)
    got = rows(resolve.normalise_bare(refs, children), "source", "prefix", "segments")
    assert got == sorted([("p", "crate", ["p", "x", "A"]), ("p", "crate", ["y", "B"]), ("p", "none", ["z", "C"]), ("", "crate", ["x", "D"]), ("p", "crate", ["x", "E"])], key=str)


def test_globs(spark):
    modules = spark.createDataFrame([("m",), ("m::in",), ("empty",)], "path string")
    items = spark.createDataFrame([("m", "Open", ""), ("m", "Sub", "m"), ("m", "Never", None), ("empty", "Hidden", None)], "module string, name string, scope string")
    refs = spark.createDataFrame(
        [("o", "crate", ["m"], True), ("m::in", "crate", ["m"], True), ("o", "crate", ["empty"], True), ("o", "crate", ["gone"], True), ("o", "crate", [], True), ("o", "crate", ["m", "T"], False)],
        REFS + ", glob boolean",
    )
    got = rows(resolve.resolve_globs(refs, items, modules), "source", "segments", "glob")
    want = [("o", ["m", "Open"], False), ("m::in", ["m", "Open"], False), ("m::in", ["m", "Sub"], False), ("o", ["gone"], True), ("o", [], True), ("o", ["m", "T"], False)]
    assert got == sorted(want, key=str)


def test_path_algebra(spark):
    df = spark.createDataFrame([("a::b::c",), ("a",), ("",), ("ab::c",)], "p string")
    got = df.select("p", P.parent(F.col("p")), P.truncated(F.col("p"), 2), P.depth_of(F.col("p")), P.prefixes(F.col("p")), P.in_subtree(F.col("p"), F.lit("a")), P.matches(F.col("p"), F.lit("a"), F.lit(False)), P.matches(F.col("p"), F.lit(""), F.lit(True))).collect()
    assert [tuple(r) for r in got] == [
        ("a::b::c", "a::b", "a::b", 3, ["a", "a::b", "a::b::c"], True, False, True),
        ("a", "", "a", 1, ["a"], True, True, True),
        ("", "", "", 0, [], False, False, True),
        ("ab::c", "ab", "ab::c", 2, ["ab", "ab::c"], False, False, True),
    ]


def test_explain(spark):
    df = spark.createDataFrame([("a", "t", "X"), ("a::b", "t", "Y"), ("ab", "t", "Z"), ("a", "u", "W")], "source string, target string, api string")
    assert rows(graph.explain(df, "a", "t"), "api") == [("X",)]
    assert rows(graph.explain(df, "a", "t", recursive=True), "api") == [("X",), ("Y",)]
    assert graph.explain(df, "a", "unknown").count() == 0
