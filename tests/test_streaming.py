from modgraph.streaming import references

SCHEMA = "source string, prefix string, segments array<string>"


def test_edges_follow_a_stream(spark, tmp_path):
    modules = spark.createDataFrame([("a",), ("b",), ("b::c",)], "path string")
    place, out = str(tmp_path / "in"), f"file://{tmp_path}/out"

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(place)
        references.follow(stream, modules, out, availableNow=True).awaitTermination()
        return sorted((r.source, r.target, r.apis) for r in references.edges_so_far(spark, out).collect())

    assert arrive(("a", "crate", ["b", "X"]), ("a", "crate", ["b", "X"])) == [("a", "b", ["X"])]
    got = arrive(("a", "crate", ["b", "Y"]), ("b", "crate", ["b", "c", "Z"]), ("b", "crate", ["b", "own"]))
    assert got == [("a", "b", ["X", "Y"]), ("b", "b::c", ["Z"])]
