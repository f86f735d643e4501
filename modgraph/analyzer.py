"""The analyser of one crate: listings, references, the dependency graph, explanations and rule checks, as tables."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modgraph.errors import CrateInfoError, ModuleAnalysisFailed, ModuleNotFound, RuleConfigError, UndeclaredModule
from modgraph.functions import paths as P
from modgraph.operators import graph, resolve, rules
from modgraph.sources.rust.crate import KINDS, Crate, Module, Target

MODULES = "path string, file string, inline string, visibility string, target_kind string, target_name string"
REFERENCE_TYPE = "source string, prefix string, levels int, segments array<string>, suffix string, suffix_text string, glob boolean"
REFERENCE = ["source", "prefix", "levels", "segments", "suffix", "suffix_text", "glob"]


@dataclass
class Graph:
    """edges (source, target, apis) and modules (path)."""

    edges: DataFrame
    modules: DataFrame

    def edge_count(self) -> int:
        return self.edges.count()

    def module_count(self) -> int:
        return self.modules.count()

    def is_empty(self) -> bool:
        return self.edges.isEmpty()


class Analyzer:
    def __init__(self, spark: SparkSession, root: str | Crate):
        self.spark, self.crate = spark, root if isinstance(root, Crate) else Crate(spark, root)

    # ---- listings

    def _default(self) -> Target:
        """Modules named on the command line are listed as the library's, whatever file they are in."""
        return Target("lib", self.crate.package, self.crate.crate_root().path)

    def _tree(self, path: str, recursive: bool, tests: bool) -> list[Module]:
        try:
            return self.crate.tree(path, tests, self._default(), recursive)
        except UndeclaredModule:
            if not tests:
                raise
        return self._test_tree(path)

    def _test_tree(self, path: str) -> list[Module]:
        for t in self.crate.targets:
            if t.kind == "test":
                found = [m for m in self.crate.file_tree(t, True) if m.path == path or m.path.startswith(f"{path}::")]
                if found:
                    return found
        raise ModuleNotFound(path)

    def list_modules(self, path: str, tests: bool = False) -> list[Module]:
        """A module and all below it, by path; the root takes the name that was asked for."""
        found = [m if m.path else Module(path, m.file, m.inline, m.visibility, m.target) for m in self._tree(path, True, tests)]
        return list({m.path: m for m in sorted(reversed(found), key=lambda m: m.path)}.values())

    def list_all_modules(self, tests: bool = False) -> list[Module]:
        """The modules of all targets, by kind and name of the target, then path."""
        out: dict[tuple, Module] = {}
        for t in self.crate.targets:
            if t.kind == "test" and not tests:
                continue
            found = self.crate.file_tree(t, tests) if t.kind == "test" else self.crate.tree(t.root_name, tests, t)
            for m in found:
                m = m if m.path else Module(t.root_name, m.file, m.inline, m.visibility, m.target)
                out.setdefault((KINDS[t.kind], t.name, m.path), m)
        return [out[k] for k in sorted(out)]

    def module_table(self, modules: list[Module]) -> DataFrame:
        rows = [(m.path, m.file, "::".join(m.inline), m.visibility, m.target.kind, m.target.name) for m in modules]
        return self.spark.createDataFrame(rows, MODULES)

    # ---- references

    def references(self, path: str, recursive: bool = False, tests: bool = False, expand: bool = False, globs: bool = False) -> DataFrame:
        """(source, prefix, levels, segments, suffix, suffix_text, glob), distinct, of a module or all below it.

        The rows that the parser took from each file meet the modules by file and inline place; whether a path is internal
        is then a matter of joins with the modules' children.
        """
        found = self._tree(path, recursive, tests)
        for m in found:
            if m.file in self.crate.errors:
                raise ModuleAnalysisFailed(m.path, m.file, str(self.crate.errors[m.file]))
        whole = found if recursive else self._whole(path, found[0].target, tests)
        children = {(p, c) for m in whole if m.path for p, _, c in [("::" + m.path).rpartition("::")]}
        children = {(p.removeprefix("::"), c) for p, c in children}
        if tests and found[0].path:
            children |= self._root_children(found[0].path)
        kids = self.spark.createDataFrame(sorted(children), "parent string, child string")
        modules = F.broadcast(self.module_table(list({m.path: m for m in found}.values())).select(F.col("path").alias("source"), "file", "inline"))
        raw = self.crate.parsed.where("row = 'reference'").join(modules, ["file", "inline"])
        refs = self._internal(raw, kids)
        if expand:
            refs = resolve.expand_groups(refs)
            kept = F.when(F.col("glob"), "glob").when(F.col("group") != "", "group").otherwise("none")
            refs = refs.withColumns({"suffix": kept, "suffix_text": F.when(F.col("glob"), "*").otherwise(F.col("group"))})
        else:
            refs = refs.withColumn("glob", F.col("suffix") == "glob")
        refs = resolve.normalise_bare(refs.select(REFERENCE), kids).distinct()
        return self._resolved(refs) if globs else refs

    def _whole(self, path: str, target: Target, tests: bool) -> list[Module]:
        try:
            return self.crate.tree(path, tests, target)
        except UndeclaredModule:
            return self._test_tree(path)

    def _root_children(self, path: str) -> set[tuple[str, str]]:
        """With tests, a module of the library also knows the library's top modules."""
        try:
            lib = self.crate.tree("lib", True, self._default())
        except CrateInfoError:
            return set()
        tops = {("", m.path) for m in lib if m.path and "::" not in m.path}
        return tops if any(m.path == path for m in lib) else set()

    def _internal(self, raw: DataFrame, kids: DataFrame) -> DataFrame:
        """References within the crate, with ``self`` and ``super`` made absolute."""
        kids = F.broadcast(kids)
        first, n = F.get("segments", F.lit(0)), F.size("segments")
        rows = raw.withColumn("_first", F.when(F.col("prefix") == "none", first))
        rows = rows.join(kids.select(F.col("parent").alias("source"), F.col("child").alias("_first"), F.lit(True).alias("_direct")), ["source", "_first"], "left")
        rows = rows.join(kids.where("parent = ''").select(F.col("child").alias("_first"), F.lit(True).alias("_root")), "_first", "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        own = F.coalesce(first == self.crate.package, F.lit(False))
        near = (F.col("prefix") != "none") | yes("_direct")
        kind = F.col("kind")
        holds = (
            F.when(kind == "use", near | yes("_root") | own)
            .when(kind == "path", near | (yes("_root") & (n > 1)))
            .when(kind == "macro", near)
            .otherwise(near | yes("_root"))
        )
        straight = rows.where(holds).select("source", "prefix", "levels", "segments", "suffix", "suffix_text", "leaves")
        via = rows.where((kind == "token") & ~holds & F.col("via_prefix").isNotNull())
        via = via.where((F.col("via_prefix") != "super") | (F.size(P.segments(F.col("source"))) >= F.col("via_levels")))
        leaf = F.array(F.struct(F.col("via_segments").alias("segments"), F.lit(False).alias("glob"), F.lit("").alias("group")))
        via = via.select("source", F.col("via_prefix").alias("prefix"), F.col("via_levels").alias("levels"), F.col("via_segments").alias("segments"), "suffix", "suffix_text", leaf.alias("leaves"))
        rows = straight.unionByName(via)
        at = P.segments(F.col("source"))
        up = (F.col("prefix") == "super") & (F.size(at) >= F.col("levels"))
        absolute = (F.col("prefix") == "self") | up
        start = F.when(absolute, F.slice(at, F.lit(1), F.size(at) - F.when(up, F.col("levels")).otherwise(0))).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("_start", start).withColumns(
            {
                "segments": F.concat("_start", "segments"),
                "leaves": F.transform("leaves", lambda x: F.struct(F.concat("_start", x["segments"]).alias("segments"), x["glob"].alias("glob"), x["group"].alias("group"))),
                "prefix": F.when(absolute, "crate").otherwise(F.col("prefix")),
                "levels": F.when(absolute, 0).otherwise(F.col("levels")),
            }
        )
        return rows.drop("_start")

    def _all_places(self) -> DataFrame:
        """(module, file, inline) of all targets, tests included."""
        modules = [m for t in self.crate.targets for m in (self.crate.file_tree(t, True) if t.kind == "test" else self.crate.tree(t.root_name, True, t))]
        return self.module_table(modules).select(F.col("path").alias("module"), "file", "inline").distinct()

    def items(self) -> DataFrame:
        """(module, name, scope): what each module of any target holds and from where it is visible."""
        rows = self.crate.parsed.where("row = 'item'").join(F.broadcast(self._all_places()), ["file", "inline"])
        names, above = F.split("vis_path", "::"), P.parent(F.col("module"))
        rest = F.slice(names, 2, F.size(names))
        below = lambda p: F.concat_ws("::", F.when(p != "", p), F.when(F.size(rest) > 0, P.joined(rest)))
        head = F.get(names, F.lit(0))
        inside = F.when(head == "crate", P.joined(rest)).when(head == "super", below(above)).when(head == "self", below(F.col("module"))).otherwise(F.col("vis_path"))
        scope = F.when(F.col("vis").isin("public", "crate"), "").when(F.col("vis") == "super", above).when(F.col("vis") == "in", inside)
        return rows.select("module", "name", scope.alias("scope")).distinct()

    def _resolved(self, refs: DataFrame) -> DataFrame:
        items = self.items()
        known = self._all_places().select(F.col("module").alias("path")).distinct()
        own = (F.col("prefix") == "none") & F.col("glob") & (F.get("segments", F.lit(0)) == self.crate.package)
        plain = resolve.resolve_globs(refs.where(~own), items, known)
        named = refs.where(own).withColumns({"segments": F.slice("segments", 2, F.size("segments")), "prefix": F.lit("crate")})
        named = resolve.resolve_globs(named, items, known).withColumns({"segments": F.concat(F.array(F.lit(self.crate.package)), "segments"), "prefix": F.lit("none")})
        rows = plain.unionByName(named)
        gone = (F.col("suffix") == "glob") & ~F.col("glob")
        return rows.withColumns({"suffix": F.when(gone, "none").otherwise(F.col("suffix")), "suffix_text": F.when(gone, "").otherwise(F.col("suffix_text"))}).distinct()

    # ---- graph

    def _package(self, modules: list[Module]) -> str | None:
        return next((m.target.name for m in modules if m.target.kind == "lib"), None)

    def _roots(self, modules: list[Module]) -> list[str]:
        """The module that each target is analysed from."""
        groups: dict[tuple, list[Module]] = {}
        for m in modules:
            groups.setdefault((KINDS[m.target.kind], m.target.name), []).append(m)
        out = []
        for key in sorted(groups):
            tops = [m for m in groups[key] if "::" not in m.path]
            if key[0] == 0:
                out.append("lib")
                continue
            liked = [m for m in tops if os.path.basename(m.file) == "main.rs" or {"bin", "tests"} & set(m.file.split(os.sep))]
            best = liked[0] if liked else min(tops, key=lambda m: m.path, default=None)
            out.append(best.path if best else key[1])
        return out

    def graph(self, tests: bool = False, depth: int | None = None, apis: bool = False) -> Graph:
        """The dependency graph of all targets; a target that cannot be analysed is left out."""
        modules = self.list_all_modules(tests)
        table = self.module_table(modules).select("path").distinct()
        parts = []
        for root in self._roots(modules):
            try:
                refs = self.references(root, recursive=True, tests=tests, expand=True)
            except (UndeclaredModule, ModuleNotFound, ModuleAnalysisFailed):
                continue
            parts.append(refs.withColumn("source", F.when(F.col("source") == "", root).otherwise(F.col("source"))))
        rows = reduce(DataFrame.unionByName, parts).distinct()
        found = resolve.targets(rows, table, self._package(modules))
        return Graph(graph.edges_of(found, depth, apis), graph.truncated_modules(table, depth))

    def explain(self, source: str, target: str, recursive: bool = False, tests: bool = False) -> DataFrame:
        """The references of a module, or of all below it, that lead to a target module."""
        modules = self.list_all_modules(tests)
        table = self.module_table(modules).select("path").distinct()
        if target != "lib" and all(m.path != target for m in modules):
            return self.spark.createDataFrame([], REFERENCE_TYPE)
        refs = self.references(source, recursive, tests, expand=True)
        found = resolve.targets(refs, table, self._package(modules)).where(F.col("target") == target)
        return found.select(refs.columns).withColumn("source", F.when(F.col("source") == "", source).otherwise(F.col("source")))

    # ---- rules

    def check(self, config: str | None = None, tests: bool = False, apis: bool = False) -> DataFrame:
        found = self.graph(tests, None, apis)
        path = rules.config_path(self.crate.root, config)
        loaded = rules.load_rules(path)
        rules.validate(loaded, found.modules, path)
        return rules.check(found.edges, found.modules, loaded)

    def init_config(self, config: str | None = None, tests: bool = False) -> str:
        """Write a first file of rules; its path. An existing file is an error."""
        modules = self.graph(tests).modules
        path = config or os.path.join(self.crate.root, rules.CONFIG)
        taken = [config] if config else [os.path.join(self.crate.root, n) for n in (rules.CONFIG, rules.HIDDEN_CONFIG)]
        for p in taken:
            if os.path.exists(p):
                raise RuleConfigError(p, "config already exists; edit it directly or remove it first")
        try:
            with open(path, "w", encoding="utf-8") as f:
                f.write(rules.scaffold(self.crate.package, modules))
        except OSError as e:
            raise RuleConfigError(path, str(e)) from None
        return path


def rendered(refs: DataFrame, depth: int | None = None) -> DataFrame:
    """references with ``text``, as they are written; names beyond the depth go, and what follows them."""
    cut = F.size("segments") > depth if depth is not None else F.lit(False)
    names = F.slice("segments", 1, depth) if depth is not None else F.col("segments")
    names = F.when(cut, names).otherwise(F.col("segments"))
    start = F.when(F.col("prefix") == "crate", "crate::").when(F.col("prefix") == "self", "self::").when(F.col("prefix") == "super", F.repeat(F.lit("super::"), F.col("levels"))).otherwise("")
    joint = F.when((F.size("segments") > 0) & F.col("suffix").isin("glob", "group"), "::").when(F.col("suffix") == "alias", " as ").otherwise("")
    end = F.when(cut, "").otherwise(F.concat(joint, "suffix_text"))
    return refs.withColumn("text", F.concat(start, P.joined(names), end))
