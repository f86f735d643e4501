from modgraph.plans import queries


def test_bare_children_of_customers_with_large_keys(spark, tmp_path):
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(7, "CHINA", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(3, 7, "A"), (60_000, 7, "B")], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in queries.bare_child_normalise(spark, str(tmp_path)).collect()}
    assert got == {("ASIA", "crate", "ASIA::CHINA::A"), ("ASIA", "crate", "ASIA::CHINA::B")}
