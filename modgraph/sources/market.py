"""Rust sources written from tables of trade: a crate whose modules are places and whose references are deliveries.

The text of every file is put together by SQL functions, one row a file, and goes through the parser like files from a
disk. Regions with a name of even length are ``region.rs``, others ``region/mod.rs``; nations whose key five divides are inline
modules of their region's file, others ``region/nation.rs``. A reference takes one of FORMS by its supplier and nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modgraph.analyzer import Analyzer
from modgraph.sources import tables
from modgraph.sources.rust.crate import Crate, Target

PACKAGE, ROOT = "market", "/market/src"
TARGETS = [Target("lib", PACKAGE, f"{ROOT}/lib.rs"), Target("bin", PACKAGE, f"{ROOT}/main.rs")]
#: How a reference is written; {p} is its path from the root, {s} the supplier and {b} the brand in it, {i} its number.
FORMS = (
    "use crate::{p}::{s}::{b};",
    "use super::super::{p}::{s}::{b} as Other{i};",
    "fn call{i}() { let x = crate::{p}::{s}::{b}(); }",
    "impl crate::{p}::{s}::{b} for Own{i} {}",
    'fn macros{i}() { run!("{}", crate::{p}::{s}::{b}); }',
    "#[with(crate::{p}::{s}::{b})]\nstruct Marked{i};",
    "fn bound{i}<T: crate::{p}::{s}::{b}>(x: T) {}",
    "fn matched{i}(x: u8) { match x { crate::{p}::{s}::{b} { .. } => {} crate::{p}::{s}::{b}(_) => {} } }",
    "use crate::{p}::{self, {s}::{b}, {s} as Own{i}};",
)
#: Visibilities of modules and items, by their key.
MODULE_VIS = ("pub ", "pub(crate) ", "", "pub(super) ")
SHARED = "pub mod shared {\n    pub struct Common;\n    pub(crate) struct Inner;\n    struct Hidden;\n    pub(in crate::asia) struct Near;\n}"


def ident(column: str):
    """A name as an identifier in lower case."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "_")


def pick(choices: tuple[str, ...], key):
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def market_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, n, p, s, b, i): the nation that refers, the path it refers to, supplier and brand, and the reference's number."""
    refs = tables.trade_references(spark, sf_dir)
    at = F.split("source", "::")
    rows = refs.select(at[0].alias("fr"), at[1].alias("fn"), *(F.col("segments")[k].alias(c) for k, c in enumerate(("tr", "tn", "ts", "tb"))))
    number = F.regexp_extract("ts", "([0-9]+)$", 1).cast("bigint") + F.regexp_extract("fn", "([0-9]+)$", 1).cast("bigint")
    return rows.select(
        ident("fr").alias("r"),
        ident("fn").alias("n"),
        F.concat_ws("::", ident("tr"), ident("tn")).alias("p"),
        F.regexp_replace("ts", "[^A-Za-z0-9]", "_").alias("s"),
        F.regexp_replace("tb", "[^A-Za-z0-9]", "_").alias("b"),
        number.alias("i"),
    )


def market_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of the whole crate."""
    place = tables.places(spark, sf_dir).select(
        F.col("n_nationkey").alias("k"), ident("r_name").alias("r"), ident("n_name").alias("n"), F.length("r_name").alias("rn")
    )
    line = pick(FORMS, F.col("i"))
    for name in ("p", "s", "b", "i"):
        line = F.replace(line, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    uses = market_references(spark, sf_dir).select("r", "n", line.alias("line")).groupBy("r", "n").agg(F.array_sort(F.collect_list("line")).alias("uses"))
    supplier = tables.table(spark, sf_dir, "supplier")
    name = F.regexp_replace("s_name", "[^A-Za-z0-9]", "_")
    items = supplier.select(F.col("s_nationkey").alias("k"), F.concat(pick(MODULE_VIS, F.col("s_suppkey")), F.lit("struct "), name, F.lit(";")).alias("item"))
    items = items.groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    test = F.when(F.col("k") % 7 == 0, F.lit("#[cfg(test)]\nmod tests { use super::*; use crate::shared::Common; }"))
    lines = F.concat(F.array(F.lit("use crate::shared::*;")), F.coalesce("items", none), F.coalesce("uses", none), F.array_compact(F.array(test)))
    full = place.join(uses, ["r", "n"], "left").join(items, "k", "left").select("k", "r", "n", "rn", F.array_join(lines, "\n").alias("body"))
    inline = F.col("k") % 5 == 0
    own = full.where(~inline).select(F.concat(F.lit(f"{ROOT}/"), "r", F.lit("/"), "n", F.lit(".rs")).alias("file"), F.col("body").alias("text"))
    declared = F.concat(pick(MODULE_VIS, F.col("k")), F.lit("mod "), "n", F.when(inline, F.concat(F.lit(" {\n"), "body", F.lit("\n}"))).otherwise(";"))
    where = F.concat(F.lit(f"{ROOT}/"), "r", F.when(F.col("rn") % 2 == 0, ".rs").otherwise("/mod.rs"))
    regions = full.groupBy(where.alias("file")).agg(F.array_join(F.array_sort(F.collect_list(declared)), "\n").alias("text"))
    tops = place.select(F.lit(f"{ROOT}/lib.rs").alias("file"), F.concat(F.lit("pub mod "), "r", F.lit(";")).alias("line")).distinct()
    lib = tops.groupBy("file").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n" + SHARED)).alias("text"))
    starts = place.where("k % 6 = 0").select(F.lit(f"{ROOT}/main.rs").alias("file"), F.concat(F.lit(f"use {PACKAGE}::"), "r", F.lit("::"), "n", F.lit(";")).alias("line"))
    main = starts.groupBy("file").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\nfn main() {}")).alias("text"))
    return own.unionByName(regions).unionByName(lib).unionByName(main)


def market(spark: SparkSession, sf_dir: str) -> Analyzer:
    return Analyzer(spark, Crate.of_sources(spark, PACKAGE, TARGETS, market_sources(spark, sf_dir)))
