"""Queries over Rust sources that are written from the driver's tables and parsed, each with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modgraph import render
from modgraph.analyzer import rendered
from modgraph.functions import paths as P
from modgraph.operators import rules
from modgraph.sources.market import PACKAGE, ROOT, market
from modgraph.storage import materialize

LAYERS = ("america", "europe", "asia", "africa")
RULES = rules.parse_rules(f'[check]\ndeny-same-layer = true\n[[check.layers]]\nname = "world"\norder = {list(LAYERS)}\n'.replace("'", '"'))
WHY = ("middle_east", "middle_east::nation_14")


def rust_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modules of all targets, test modules too."""
    found = market(spark, sf_dir)
    target = F.concat("target_kind", F.when(F.col("target_kind") != "lib", F.concat(F.lit(":"), "target_name")).otherwise(""))
    return found.module_table(found.list_all_modules(True)).select("path", "file", "inline", "visibility", target.alias("target"))


def rust_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market(spark, sf_dir)
    return found.module_table(found.list_modules("africa")).select("path", P.parent(F.col("path")).alias("parent"), P.depth_of(F.col("path")).alias("depth"))


def rust_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each place declares, and from where it is visible."""
    return market(spark, sf_dir).items().where(F.col("name").startswith("Supplier_") | (F.col("module") == "shared"))


def rust_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as they are written, ``super`` made absolute."""
    return rendered(market(spark, sf_dir).references("lib", recursive=True)).select("source", "text").distinct()


def rust_use_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as one reference an item, globs as the items that the module may see."""
    refs = market(spark, sf_dir).references("lib", recursive=True, expand=True, globs=True)
    return rendered(refs).select("source", "text").distinct()


def rust_use_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References cut after two names."""
    return rendered(market(spark, sf_dir).references("lib", recursive=True), 2).select("source", "text").distinct()


def rust_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = market(spark, sf_dir).graph(apis=True).edges
    return edges.select("source", "target", F.array_join("apis", ",").alias("apis"))


def rust_deps_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With test modules, which the depth folds into the modules they are in."""
    edges = market(spark, sf_dir).graph(tests=True, depth=2, apis=True).edges
    return edges.select("source", "target", F.array_join("apis", ",").alias("apis"))


def rust_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market(spark, sf_dir).explain(*WHY, recursive=True)
    return rendered(found).select("source", "text").distinct()


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market(spark, sf_dir).graph()
    return rules.check(materialize(found.edges), found.modules, RULES)


def rust_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).select("kind", "source", "target", "rule")


def rust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints: (form, n, line)."""
    found = market(spark, sf_dir)
    edges = render.sorted_edges(found.graph(apis=True).edges)
    bare = [(s, t, []) for s, t, _ in edges]
    broken = _violations(spark, sf_dir).orderBy(*rules.VIOLATION_ORDER).collect()
    texts = {
        "plain": render.deps(edges),
        "grouped": render.deps(edges, "grouped"),
        "dot": render.deps(bare, "dot"),
        "list": render.listing(found.list_all_modules(), ROOT, "plain", True, True, True),
        "check": render.violations(broken, "modgraph"),
    }
    rows = [(form, n, line) for form, text in texts.items() for n, line in enumerate(text.removesuffix("\n").split("\n"), 1)]
    return spark.createDataFrame(rows, "form string, n int, line string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (rust_list, rust_subtree, rust_items, rust_use, rust_use_expanded, rust_use_depth, rust_deps, rust_deps_tests, rust_why, rust_check, rust_lines)
}

# ---- the same in DuckDB SQL

_VIS = "case {} % 4 when 0 then 'pub' when 1 then 'pub(crate)' when 2 then '' else 'pub(super)' end"
_PLACES = f"""place as (select n_nationkey as k, regexp_replace(lower(r_name), '[^a-z0-9]', '_', 'g') as r, regexp_replace(lower(n_name), '[^a-z0-9]', '_', 'g') as n,
  length(r_name) % 2 = 0 as flat, n_nationkey % 5 = 0 as inside from nation join region on n_regionkey = r_regionkey),
module as (
  select 'lib' as target, 'lib' as path, '{ROOT}/lib.rs' as file, '' as inline, 'pub' as visibility, false as test
  union select 'lib', 'shared', '{ROOT}/lib.rs', 'shared', 'pub', false
  union select 'bin:{PACKAGE}', 'main', '{ROOT}/main.rs', '', 'pub', false
  union select 'lib', r, '{ROOT}/' || r || case when flat then '.rs' else '/mod.rs' end, '', 'pub', false from place
  union select 'lib', r || '::' || n, '{ROOT}/' || r || case when not inside then '/' || n || '.rs' when flat then '.rs' else '/mod.rs' end,
    case when inside then n else '' end, {_VIS.format("k")}, false from place
  union select 'lib', r || '::' || n || '::tests', '{ROOT}/' || r || case when not inside then '/' || n || '.rs' when flat then '.rs' else '/mod.rs' end,
    case when inside then n || '::' else '' end || 'tests', '', true from place where k % 7 = 0)"""
_REFS = f"""{_PLACES},
trade as (select distinct c.r || '::' || c.n as source, t.r || '::' || t.n as p, regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') as s,
    regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') as b, regexp_extract(s_name, '([0-9]+)$', 1)::bigint + regexp_extract(c.n, '([0-9]+)$', 1)::bigint as i
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join part on l_partkey = p_partkey join place c on c.k = c_nationkey join place t on t.k = s_nationkey where l_quantity >= 50 and l_discount >= 0.10)"""
_LEAVES = """leaf as (select source, p, s || '::' || b as api from trade union select source, p, s from trade where i % 9 = 8 union select source, p, '' from trade where i % 9 = 8)"""
_EDGES = f"""{_LEAVES},
link as (select * from leaf union select r || '::' || n, 'shared', '' from place union select 'main', r || '::' || n, '' from place where k % 6 = 0),
edges as (select source, p as target, coalesce(string_agg(distinct api, ',' order by api) filter (where api <> ''), '') as apis from link where source <> p group by all)"""
_FOUND = f"""{_EDGES},
layer(name, idx) as (values {", ".join(f"('{n}', {i})" for i, n in enumerate(LAYERS))}),
broken as (select 'LAYER' as kind, source, target, 'layer ''world'' forbids ' || case when a.idx > b.idx then 'upward' else 'same-layer' end
    || ' dependency (' || source || ' -> ' || target || ')' as rule
  from edges join layer a on split_part(source, '::', 1) = a.name join layer b on split_part(target, '::', 1) = b.name where a.idx >= b.idx)"""
_TOLD = "case when apis = '' then '' else ' [' || replace(apis, ',', ', ') || ']' end"
_HEAD_LINES = ", ".join(f"({i}, '{line}')" for i, line in enumerate(render.HEAD.removesuffix("\n").split("\n"), 1))
_HEAD_COUNT = render.HEAD.count("\n")

ORACLE_SQL: dict[str, str] = {
    "rust_list": f"with {_PLACES} select path, file, inline, visibility, target from module",
    "rust_subtree": f"""with {_PLACES} select path, array_to_string(string_split(path, '::')[:-2], '::') as parent, len(string_split(path, '::')) as depth
from module where not test and (path = 'africa' or starts_with(path, 'africa::'))""",
    "rust_items": f"""with {_PLACES} select r || '::' || n as module, regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') as name,
  case s_suppkey % 4 when 0 then '' when 1 then '' when 3 then r end as scope from supplier join place on s_nationkey = k
union all select * from (values ('shared', 'Common', ''), ('shared', 'Inner', ''), ('shared', 'Hidden', null), ('shared', 'Near', 'asia'))""",
    "rust_use": f"""with {_REFS} select source, 'crate::' || p || '::' || case i % 9 when 8 then '{{self, ' || s || '::' || b || ', ' || s || ' as Own' || i || '}}'
  when 1 then s || '::' || b || ' as Other' || i else s || '::' || b end as text from trade
union select r || '::' || n, 'crate::shared::*' from place""",
    "rust_use_expanded": f"""with {_REFS}, {_LEAVES} select source, 'crate::' || p || case when api = '' then '' else '::' || api end as text from leaf
union select r || '::' || n, 'crate::shared::' || name from place, (values ('Common'), ('Inner'), ('Near')) v(name) where name <> 'Near' or r = 'asia'""",
    "rust_use_depth": f"""with {_REFS} select distinct source, 'crate::' || p || case when i % 9 = 8 then '::{{self, ' || s || '::' || b || ', ' || s || ' as Own' || i || '}}' else '' end as text from trade
union select r || '::' || n, 'crate::shared::*' from place""",
    "rust_deps": f"with {_REFS}, {_EDGES} select source, target, apis from edges",
    "rust_deps_tests": f"""with {_REFS}, {_EDGES} select source, target, case when target = 'shared' and k % 7 = 0 then 'Common' else apis end as apis
from edges left join place on source = r || '::' || n""",
    "rust_why": f"""with {_REFS}, {_LEAVES} select source, 'crate::' || p || case when api = '' then '' else '::' || api end as text from leaf
where p = '{WHY[1]}' and starts_with(source, '{WHY[0]}::')""",
    "rust_check": f"with {_REFS}, {_FOUND} select kind, source, target, rule from broken",
    "rust_lines": f"""with {_REFS}, {_FOUND},
listed as (select target, path, visibility, replace(file, '{ROOT}/', '') as file, '[' || target || ']' as tag from module where not test),
wide as (select max(length(tag)) as wt, max(length(path)) as wp, max(length(visibility)) as wv from listed),
firsts as (select source, count(*) as c, row_number() over (order by source) as g from edges group by source),
grouped as (select g, 0 as o, '' as target, source || ' (' || c || ')' as line from firsts
  union all select g, 1, target, '  -> ' || target || {_TOLD} from edges join firsts using (source)
  union all select g, 2, '', '' from firsts where g < (select max(g) from firsts)),
node as (select source as name from edges union select target from edges),
counts as (select count(*) as nodes, (select count(*) from edges) as es from node)
select 'plain' as form, (row_number() over (order by source, target))::int as n, source || ' -> ' || target || {_TOLD} as line from edges
union all select 'grouped', (row_number() over (order by g, o, target))::int, line from grouped
union all select 'dot', n, line from (values {_HEAD_LINES}) h(n, line)
union all select 'dot', unnest([{_HEAD_COUNT + 1}, {_HEAD_COUNT + 2} + nodes, {_HEAD_COUNT + 3} + nodes + es])::int, unnest(['', '', '}}']) from counts
union all select 'dot', ({_HEAD_COUNT + 1} + row_number() over (order by name))::int, '    "' || name || '";' from node
union all select 'dot', ({_HEAD_COUNT + 2} + nodes + row_number() over (order by source, target))::int, '    "' || source || '" -> "' || target || '";' from edges, counts
union all select 'list', (row_number() over (order by target = 'lib' desc, target, path))::int,
  rpad(tag, wt::int, ' ') || ' ' || rpad(path, wp::int, ' ') || '  ' || rpad(visibility, wv::int, ' ') || '  ' || file from listed, wide
union all select 'check', 1, 'modgraph check: ' || count(*) || ' violations' from broken
union all select 'check', 2, ''
union all select 'check', (2 + row_number() over (order by kind, source, target, rule))::int, '  ' || kind || ' ' || source || ' -> ' || target || '   (rule: ' || rule || ')' from broken""",
}
