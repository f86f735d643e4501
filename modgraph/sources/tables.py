"""Adapters that read the graph's relations from tables of trade: places as modules, deliveries as references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, path, r_name, n_name)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return rows.select("n_nationkey", F.concat_ws("::", "r_name", "n_name").alias("path"), "r_name", "n_name")


def trade_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of all nations, two names deep."""
    return places(spark, sf_dir).select("path")


#: The parts of the trade that ``trade_references`` tells apart; an order may be in both or in neither.
PARTS = {"finished": "o_orderstatus = 'F'", "even": "o_custkey % 2 = 0"}


def trade_references(spark: SparkSession, sf_dir: str, parts: bool = False) -> DataFrame:
    """(source, prefix, segments): from a customer's nation to region, nation, supplier and brand of large, cheap items.

    The selective filter on items reaches the scan; with all items every nation would refer to every other one. Nations
    are a handful of rows and are broadcast, suppliers and the tables of orders, customers and parts are joined as the
    planner sees fit. Distinct references leave here. With ``parts`` they have a column part, one row for each of PARTS
    that the order is in; the tables are still read once.
    """
    place = F.broadcast(places(spark, sf_dir))
    items = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.10")
    orders = table(spark, sf_dir, "orders")
    names = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in PARTS.items())))
    orders = orders.select("o_orderkey", "o_custkey", *([F.explode(names).alias("part")] if parts else []))
    rows = (
        items.select("l_orderkey", "l_partkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(place.select(F.col("n_nationkey").alias("c_nationkey"), F.col("path").alias("source")), "c_nationkey")
        .join(place.select(F.col("n_nationkey").alias("s_nationkey"), "r_name", "n_name"), "s_nationkey")
    )
    named = F.array("r_name", "n_name", "s_name", "p_brand").alias("segments")
    return rows.select(*(["part"] if parts else []), "source", F.lit("crate").alias("prefix"), named).distinct()


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang, word): the words that each page links to, and the language that its url names."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"/]*)"'), F.lit(1))))
    source = F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("source")
    lang = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("lang")
    return table(spark, sf_dir, "pages").select(source, lang, words.alias("word")).where("word <> '' and lang <> ''")


def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of known places of pages, one to three names deep: languages but English, their words that three pages
    link to, and the index of those that ten link to."""
    told = _links(spark, sf_dir).groupBy("lang", "word").agg(F.count("*").alias("n"))
    paths = F.array_compact(
        F.array(
            F.when(F.col("lang") != "en", F.col("lang")),
            F.when(F.col("n") >= 3, F.concat_ws("::", "lang", "word")),
            F.when(F.col("n") >= 10, F.concat_ws("::", "lang", "word", F.lit("index"))),
        )
    )
    return told.select(F.explode(paths).alias("path")).distinct()


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, prefix, segments) of links in pages: the page's number, and language, word, index and a name behind it."""
    names = F.array("lang", "word", F.lit("index"), F.lit("title")).alias("segments")
    return _links(spark, sf_dir).select("source", F.lit("crate").alias("prefix"), names)
