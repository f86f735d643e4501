"""The query catalogue over the driver's tables, each with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modgraph.functions import paths as P
from modgraph.operators import graph, resolve, rules
from modgraph.plans import rust_queries
from modgraph.sources import tables
from modgraph.sources.rust.items import token_paths
from modgraph.storage import materialize

RULES = rules.parse_rules(
    """
[check]
deny-same-layer = true
[[check.layers]]
name = "world"
order = ["AMERICA", "EUROPE", "ASIA", "AFRICA"]
[[check.layers]]
name = "south"
order = ["AFRICA::NATION_0", "AFRICA", "MIDDLE EAST"]
deny-same-layer = false
[[check.deny]]
from = "ASIA::*"
to = "EUROPE::*"
[[check.deny]]
from = "*"
to = "AMERICA::NATION_1"
"""
)
#: A path of the trade graph that takes many steps at small scale.
PATH_ENDS = ("AFRICA::NATION_20", "AFRICA::NATION_10")
WHY_ENDS = ("EUROPE::NATION_13", "ASIA::NATION_17")


def _edges(spark: SparkSession, sf_dir: str, depth: int | None = None) -> DataFrame:
    modules = tables.trade_modules(spark, sf_dir)
    return graph.edges_of(resolve.targets(tables.trade_references(spark, sf_dir), modules), depth)


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.array_join("apis", ",").alias("apis"))


def module_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = tables.places(spark, sf_dir)
    supplier = tables.table(spark, sf_dir, "supplier")
    deep = supplier.join(F.broadcast(place), supplier.s_nationkey == place.n_nationkey)
    three = deep.select(F.concat_ws("::", "path", "s_name").alias("path"), F.lit(3).alias("depth"))
    two = place.select("path", F.lit(2).alias("depth"))
    one = place.select(F.col("r_name").alias("path"), F.lit(1).alias("depth")).distinct()
    rows = one.unionByName(two).unionByName(three)
    return rows.select("path", P.parent(F.col("path")).alias("parent"), "depth").dropDuplicates(["path"])


def module_filter_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = module_list(spark, sf_dir)
    return rows.where((P.depth_of(F.col("path")) <= 2) & F.contains("path", F.lit("A::N"))).select("path")


def deps_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("source", "target")


def deps_edges_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_edges(spark, sf_dir))


def deps_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, depth=1).select("source", "target")


def deps_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of two overlapping parts of the trade, read at once, as one."""
    refs = tables.trade_references(spark, sf_dir, parts=True)
    parts = graph.edges_of(resolve.targets(refs, tables.trade_modules(spark, sf_dir)), by=("part",))
    return _flat(graph.merged([parts]))


def deps_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_out(_edges(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_edges(spark, sf_dir), tables.trade_modules(spark, sf_dir))


def orphans_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = graph.truncated_modules(tables.trade_modules(spark, sf_dir), 1)
    return graph.orphans(_edges(spark, sf_dir, depth=1), modules)


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_edges(spark, sf_dir))


def cycles_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles by rounds of joins, as graphs beyond the driver's limit are walked."""
    return graph.cycles(_edges(spark, sf_dir), local_edges=0)


def shortest_paths_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(_edges(spark, sf_dir), *PATH_ENDS, local_edges=0)
    return found.select(F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("length"))


def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_edges(spark, sf_dir))
    return _flat_cycles(graph.cycle_edges(edges, graph.cycles(edges)))


def _flat_cycles(rows: DataFrame) -> DataFrame:
    return rows.select("cycle_id", "source", "target", F.array_join("apis", ",").alias("apis"))


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(_edges(spark, sf_dir), *PATH_ENDS)
    return found.select(F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("length"))


def why_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.targets(tables.trade_references(spark, sf_dir), tables.trade_modules(spark, sf_dir))
    rows = graph.explain(found, *WHY_ENDS)
    return rows.select("source", F.concat(F.lit("crate::"), P.joined(F.col("segments"))).alias("reference")).distinct()


def _violations(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "source", "target", "rule", F.array_join("apis", ",").alias("apis"))


def check_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_edges(spark, sf_dir))
    return _violations(rules.layer_violations(edges, tables.trade_modules(spark, sf_dir), RULES))


def check_same_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies within a layer of a group that denies them, and no others."""
    return check_layers(spark, sf_dir).where(F.contains("rule", F.lit("forbids same-layer")))


def check_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(rules.deny_violations(_edges(spark, sf_dir), RULES))


def check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_edges(spark, sf_dir))
    return _violations(rules.check(edges, tables.trade_modules(spark, sf_dir), RULES))


def layer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.memberships(tables.trade_modules(spark, sf_dir), RULES).select("path", "group_name", "idx")


def strict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    south = rules.RuleSet(RULES.layers[1:], (), True)
    return rules.uncovered(south, tables.trade_modules(spark, sf_dir))


def unknown_rule_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = rules.parse_rules(
        '[[check.layers]]\nname = "g"\norder = ["ASIA", "ATLANTIS"]\n[[check.deny]]\nfrom = "ASIA::*"\nto = "EUROPE"\n[[check.deny]]\nfrom = "*"\nto = "MU::*"\n[check]\n'.replace("[check]\n", "")
    )
    return rules.unknown_patterns(odd, tables.trade_modules(spark, sf_dir)).select("module", "rule")


def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = materialize(tables.page_modules(spark, sf_dir))
    return resolve.targets(tables.page_references(spark, sf_dir), modules).select("source", "target", "api")


def group_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    leaf = lambda *names: F.struct(F.array("p_brand", *names).alias("segments"), F.lit(False).alias("glob"))
    whole = F.struct(F.array(F.col("p_brand")).alias("segments"), F.lit(True).alias("glob"))
    refs = part.select("p_partkey", F.array(leaf("p_type"), leaf("p_type", "p_name"), whole).alias("leaves"))
    rows = resolve.expand_groups(refs)
    text = F.concat(P.joined(F.col("segments")), F.when(F.col("glob"), "::*").otherwise(""))
    return rows.select("p_partkey", text.alias("reference"))


def glob_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as items of their nations: visible everywhere, in their region, in their nation or nowhere by number."""
    place = F.broadcast(tables.places(spark, sf_dir))
    supplier = tables.table(spark, sf_dir, "supplier")
    kind = F.col("s_suppkey") % 4
    scope = F.when(kind == 0, "").when(kind == 1, F.col("r_name")).when(kind == 2, F.col("path"))
    items = supplier.join(place, supplier.s_nationkey == place.n_nationkey).select(F.col("path").alias("module"), F.col("s_name").alias("name"), scope.alias("scope"))
    edges = _edges(spark, sf_dir).select("source", P.segments(F.col("target")).alias("segments"))
    refs = edges.select("source", F.lit("crate").alias("prefix"), "segments", F.lit(True).alias("glob"))
    found = resolve.resolve_globs(refs, items, tables.trade_modules(spark, sf_dir))
    return found.select("source", P.joined(F.col("segments")).alias("reference"), "glob")


def bare_child_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that start with a bare nation or region, seen from regions and nations."""
    place = tables.places(spark, sf_dir)
    children = place.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).unionByName(place.select(F.lit("").alias("parent"), F.col("r_name").alias("child")))
    customer = tables.table(spark, sf_dir, "customer")
    of = customer.join(F.broadcast(place), customer.c_nationkey == place.n_nationkey)
    first = F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.col("r_name")).otherwise("elsewhere")
    refs = of.select(F.col("r_name").alias("source"), F.lit("none").alias("prefix"), F.array(first, F.col("c_mktsegment")).alias("segments"))
    found = resolve.normalise_bare(refs, children)
    return found.select("source", "prefix", P.joined(F.col("segments")).alias("reference")).distinct()


#: What ``path_tokens`` makes of a text: signs that tokens cannot have part it, sentences become paths.
TEXT_STEPS = (("[^A-Za-z,. \n]+", ";"), ("[,.][ \n]+", "::"), ("[,.]", ";"))


def _token_paths(texts: pa.Array) -> pa.Array:
    return pa.array([token_paths(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the scan of a macro's tokens finds in whole documents, names before a comma or stop leading on."""
    text = F.col("text")
    for old, new in TEXT_STEPS:
        text = F.regexp_replace(text, old, new)
    source = F.concat(F.lit("x = a :: b; "), F.coalesce(text, F.lit("")))
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.arrow_udf(_token_paths, "array<string>")(source)).alias("path"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = rust_queries.QUERIES | {
    f.__name__: f
    for f in (
        module_list,
        module_filter_depth,
        deps_edges,
        deps_edges_apis,
        deps_depth1,
        deps_merged,
        deps_fanout,
        orphans,
        orphans_depth1,
        cycles,
        cycles_distributed,
        cycle_edges,
        shortest_paths,
        shortest_paths_distributed,
        why_edge,
        check_layers,
        check_same_layer,
        check_deny,
        check_all,
        layer_members,
        strict_coverage,
        unknown_rule_modules,
        prefix_resolve,
        group_expand,
        glob_resolve,
        bare_child_normalise,
        path_tokens,
    )
}

# ---- the same in DuckDB SQL


def _trade(where: str = "") -> str:
    where = f" and {where}" if where else ""
    return f"""place as (select n_nationkey, r_name || '::' || n_name as path, r_name, n_name from nation join region on n_regionkey = r_regionkey),
modules as (select path from place),
told as (select distinct c.path as source, t.path as target, t.r_name as source_region_of_target, s_name || '::' || p_brand as api
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  join place c on c.n_nationkey = c_nationkey join place t on t.n_nationkey = s_nationkey
  where l_quantity >= 50 and l_discount >= 0.10{where}),
edges as (select source, target, string_agg(distinct api, ',' order by api) as apis from told where source <> target group by all)"""


TRADE = f"with recursive {_trade()}"
_CLOSURE = """reach(source, target) as (select source, target from edges union select r.source, e.target from reach r join edges e on r.target = e.source),
members as (select a.source as path, least(a.source, min(a.target)) as component from reach a join reach b on a.source = b.target and a.target = b.source
  where a.source <> a.target group by a.source),
cycle as (select dense_rank() over (order by component) as cycle_id, path from members)"""
_LAYER_ROWS = ", ".join(
    f"({g}, '{group.name}', {i}, '{p.base}', {p.specificity}, {str(group.deny_same).lower()})"
    for g, group in enumerate(RULES.layers)
    for i, p in enumerate(group.order)
)
_MEMBER = f"""layer(group_no, group_name, idx, base, specificity, deny_same) as (values {_LAYER_ROWS}),
member as (select path, group_no, group_name, idx, deny_same from (
  select path, l.*, row_number() over (partition by path, group_no order by specificity desc, idx) as r
  from modules join layer l on path = base or starts_with(path, base || '::')) where r = 1)"""
_LAYER_CHECK = """select 'LAYER' as kind, source, target,
  'layer ''' || a.group_name || ''' forbids ' || case when a.idx > b.idx then 'upward' else 'same-layer' end || ' dependency (' || source || ' -> ' || target || ')' as rule, apis
  from edges join member a on a.path = source join member b on b.path = target and a.group_no = b.group_no
  where a.idx > b.idx or (a.idx = b.idx and a.deny_same)"""
_SAME_LAYER = _LAYER_CHECK.replace("where a.idx > b.idx or (a.idx = b.idx and a.deny_same)", "where a.idx = b.idx and a.deny_same")
_DENY_CHECK = """select 'DENY' as kind, source, target, rule, apis from edges join (values
  ('deny ASIA::* -> EUROPE::*', 'ASIA', 'EUROPE', true), ('deny * -> AMERICA::NATION_1', '', 'AMERICA::NATION_1', false)) d(rule, f, t, sub)
  on (f = '' or source = f or starts_with(source, f || '::')) and (target = t or (sub and starts_with(target, t || '::')))"""
_LINKS = """link as (select * from (select 'page' || page_id as source, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) as lang,
  unnest(list_distinct(regexp_extract_all(html, 'href="/([^"/]*)"', 1))) as word from pages) where word <> '' and lang <> ''),
known as (select lang, word, count(*) as n from link group by all)"""

_SHORTEST = f"""{TRADE},
dist(path, d) as (select '{PATH_ENDS[0]}', 0 union select target, d + 1 from dist join edges on source = path where d < 25),
near as (select path, min(d) as d from dist group by path),
walk(path, head, d) as (select '{PATH_ENDS[1]}', '{PATH_ENDS[1]}', d from near where path = '{PATH_ENDS[1]}'
  union all select e.source || ' -> ' || w.path, e.source, w.d - 1 from walk w join edges e on e.target = w.head join near n on n.path = e.source and n.d = w.d - 1)
select path, len(string_split(path, ' -> ')) - 1 as length from walk where d = 0"""

_TEXT = "text"
for _old, _new in TEXT_STEPS:
    _TEXT = f"regexp_replace({_TEXT}, '{_old}', '{_new}', 'g')"

ORACLE_SQL: dict[str, str] = rust_queries.ORACLE_SQL | {
    "module_list": """with place as (select n_nationkey, r_name, n_name from nation join region on n_regionkey = r_regionkey)
select distinct r_name as path, '' as parent, 1 as depth from place
union all select distinct r_name || '::' || n_name, r_name, 2 from place
union all select distinct r_name || '::' || n_name || '::' || s_name, r_name || '::' || n_name, 3 from place join supplier on s_nationkey = n_nationkey""",
    "module_filter_depth": """select distinct r_name || '::' || n_name as path from nation join region on n_regionkey = r_regionkey
where contains(r_name || '::' || n_name, 'A::N')""",
    "deps_edges": f"{TRADE} select source, target from edges",
    "deps_edges_apis": f"{TRADE} select source, target, apis from edges",
    "deps_depth1": f"""{TRADE} select distinct string_split(source, '::')[1] as source, string_split(target, '::')[1] as target from told
where string_split(source, '::')[1] <> string_split(target, '::')[1]""",
    "deps_merged": "with "
    + ", ".join(f"part{i} as (with {_trade(w)} select source, target, unnest(string_split(apis, ',')) as api from edges)" for i, w in enumerate(tables.PARTS.values()))
    + " select source, target, string_agg(distinct api, ',' order by api) as apis from (select * from part0 union all select * from part1) group by all",
    "deps_fanout": f"{TRADE} select source, count(distinct target) as targets from edges group by source",
    "orphans": f"{TRADE} select path from modules where path not in (select target from edges)",
    "orphans_depth1": f"""{TRADE} select distinct string_split(path, '::')[1] as path from modules where string_split(path, '::')[1] not in
(select string_split(target, '::')[1] from told where string_split(source, '::')[1] <> string_split(target, '::')[1])""",
    "cycles": f"{TRADE}, {_CLOSURE} select cycle_id, path from cycle",
    "cycles_distributed": f"{TRADE}, {_CLOSURE} select cycle_id, path from cycle",
    "cycle_edges": f"""{TRADE}, {_CLOSURE}
select a.cycle_id, source, target, apis from edges join cycle a on a.path = source join cycle b on b.path = target and a.cycle_id = b.cycle_id""",
    "shortest_paths": _SHORTEST,
    "shortest_paths_distributed": _SHORTEST,
    "why_edge": f"""{TRADE} select distinct source, 'crate::' || target || '::' || api as reference from told
where source = '{WHY_ENDS[0]}' and target = '{WHY_ENDS[1]}'""",
    "check_layers": f"{TRADE}, {_MEMBER} {_LAYER_CHECK}",
    "check_same_layer": f"{TRADE}, {_MEMBER} {_SAME_LAYER}",
    "check_deny": f"{TRADE} {_DENY_CHECK}",
    "check_all": f"{TRADE}, {_MEMBER} {_DENY_CHECK} union all {_LAYER_CHECK}",
    "layer_members": f"{TRADE}, {_MEMBER} select path, group_name, idx from member",
    "strict_coverage": f"{TRADE} select path from modules where not starts_with(path, 'AFRICA::') and not starts_with(path, 'MIDDLE EAST::')",
    "unknown_rule_modules": f"""{TRADE} select module, rule from (values ('ASIA', 'ASIA', true, 'layers ''g'''), ('ATLANTIS', 'ATLANTIS', true, 'layers ''g'''),
  ('ASIA::*', 'ASIA', true, 'deny ASIA::* -> EUROPE'), ('EUROPE', 'EUROPE', false, 'deny ASIA::* -> EUROPE'), ('MU::*', 'MU', true, 'deny * -> MU::*')) p(module, base, sub, rule)
where not exists (select 1 from modules where path = base or (sub and starts_with(path, base || '::')))""",
    "prefix_resolve": f"""with {_LINKS} select source,
  case when n >= 10 then lang || '::' || word || '::index' when n >= 3 then lang || '::' || word when lang <> 'en' then lang else 'lib' end as target,
  case when n >= 10 then 'title' when n >= 3 then 'index::title' when lang <> 'en' then word || '::index::title' else lang || '::' || word || '::index::title' end as api
  from link join known using (lang, word)""",
    "group_expand": """select p_partkey, unnest([p_brand || '::' || p_type, p_brand || '::' || p_type || '::' || p_name, p_brand || '::*']) as reference from part""",
    "glob_resolve": f"""{TRADE},
items as (select path as module, s_name as name, case s_suppkey % 4 when 0 then '' when 1 then r_name when 2 then path end as scope
  from supplier join place on s_nationkey = n_nationkey)
select distinct source, target || '::' || name as reference, false as glob from edges join items on module = target
where scope is not null and (scope = '' or source = scope or starts_with(source, scope || '::'))""",
    "bare_child_normalise": """with place as (select n_nationkey, r_name, n_name from nation join region on n_regionkey = r_regionkey)
select distinct r_name as source, case when c_custkey % 3 = 2 then 'none' else 'crate' end as prefix,
  case c_custkey % 3 when 0 then r_name || '::' || n_name when 1 then r_name else 'elsewhere' end || '::' || c_mktsegment as reference
from customer join place on c_nationkey = n_nationkey where c_custkey <= 5000""",
    "path_tokens": f"""select doc_id, regexp_replace(unnest(regexp_extract_all('x = a :: b; ' || coalesce({_TEXT}, ''),
  '[A-Za-z]+(?:\\s*::\\s*[A-Za-z]+)+')), '\\s+', '', 'g') as path from documents""",
}
