"""Architecture rules: layers that may only depend downward, and forbidden dependencies."""

from __future__ import annotations

import os
import re
import tomllib
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modgraph.errors import RuleConfigError, UnknownRuleModule
from modgraph.functions import paths as P
from modgraph.storage import checked

CONFIG, HIDDEN_CONFIG = "modgraph.toml", ".modgraph.toml"
LAYERS = "group_no int, group_name string, idx int, base string, subtree boolean, specificity int, deny_same boolean"
DENY = "rule_no int, from_base string, from_subtree boolean, to_base string, to_subtree boolean, display string"
VIOLATION_ORDER = ["kind", "source", "target", "rule", "apis"]


@dataclass(frozen=True)
class Pattern:
    """``a::b`` for a module, ``a::b::*`` for it and all below, ``*`` for everything."""

    base: str
    subtree: bool

    @staticmethod
    def parse(text: str, subtree: bool = False) -> Pattern:
        if text == "*":
            return Pattern("", True)
        base = text.removesuffix("::*")
        return Pattern(base, subtree or base != text)

    @property
    def specificity(self) -> int:
        return len(self.base.split("::")) if self.base else 0

    def __str__(self) -> str:
        return (self.base + ("::*" if self.subtree else "")) if self.base else "*"


@dataclass(frozen=True)
class Layers:
    name: str
    order: tuple[Pattern, ...]
    deny_same: bool


@dataclass(frozen=True)
class Deny:
    source: Pattern
    target: Pattern

    def __str__(self) -> str:
        return f"deny {self.source} -> {self.target}"


@dataclass(frozen=True)
class RuleSet:
    layers: tuple[Layers, ...] = field(default=())
    deny: tuple[Deny, ...] = field(default=())
    strict: bool = False

    def layer_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (g, group.name, i, p.base, p.subtree, p.specificity, group.deny_same)
            for g, group in enumerate(self.layers)
            for i, p in enumerate(group.order)
        ]
        return spark.createDataFrame(rows, LAYERS)

    def deny_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, d.source.base, d.source.subtree, d.target.base, d.target.subtree, str(d)) for n, d in enumerate(self.deny)]
        return spark.createDataFrame(rows, DENY)


# ---- configuration


def config_path(root: str, explicit: str | None = None) -> str:
    """The file of rules: the one asked for, else the plain or the hidden one in the root."""
    if explicit is not None:
        if os.path.isfile(explicit):
            return explicit
        raise RuleConfigError(explicit, "config file does not exist")
    plain, hidden = os.path.join(root, CONFIG), os.path.join(root, HIDDEN_CONFIG)
    if os.path.isfile(plain):
        if os.path.isfile(hidden):
            warnings.warn(f"both {CONFIG} and {HIDDEN_CONFIG} found, using {CONFIG}", stacklevel=2)
        return plain
    if os.path.isfile(hidden):
        return hidden
    raise RuleConfigError(root, f"no {CONFIG} or {HIDDEN_CONFIG} found in {root}; run `modgraph check --init` to generate a starter config")


def parse_rules(text: str, path: str = "") -> RuleSet:
    """Rules of a TOML text; RuleConfigError for what does not belong there."""

    def only(table, known: dict[str, type], where: str) -> dict:
        if not isinstance(table, dict):
            raise RuleConfigError(path, f"{where} must be a table")
        for key, value in table.items():
            if key not in known:
                raise RuleConfigError(path, f"unknown field `{key}` in {where}, expected one of {', '.join(known)}")
            if not isinstance(value, known[key]):
                raise RuleConfigError(path, f"invalid type of `{key}` in {where}")
        return table

    def required(table: dict, where: str, *keys: str) -> None:
        for key in keys:
            if key not in table:
                raise RuleConfigError(path, f"missing field `{key}` in {where}")

    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RuleConfigError(path, str(e)) from None
    only(raw, {"check": dict}, "the file")
    required(raw, "the file", "check")
    check = only(raw["check"], {"layers": list, "deny": list, "strict-layers": bool, "deny-same-layer": bool}, "check")
    same, layers, deny = check.get("deny-same-layer", False), [], []
    for group in check.get("layers", []):
        only(group, {"name": str, "order": list, "deny-same-layer": bool}, "check.layers")
        required(group, "check.layers", "name", "order")
        if not all(isinstance(x, str) for x in group["order"]):
            raise RuleConfigError(path, "invalid type in `order` of check.layers")
        if any(group["name"] == g.name for g in layers):
            raise RuleConfigError(path, f"duplicate layer group name '{group['name']}' (line {_line_of_name(text, len(layers))})")
        order = tuple(Pattern.parse(x, subtree=True) for x in group["order"])
        layers.append(Layers(group["name"], order, group.get("deny-same-layer", same)))
    for rule in check.get("deny", []):
        only(rule, {"from": str, "to": str}, "check.deny")
        required(rule, "check.deny", "from", "to")
        deny.append(Deny(Pattern.parse(rule["from"]), Pattern.parse(rule["to"])))
    return RuleSet(tuple(layers), tuple(deny), check.get("strict-layers", False))


def _line_of_name(text: str, group: int) -> int:
    """The line of the name of a layer group, counted from 0, where the groups are written as array tables."""
    heads = [m.end() for m in re.finditer(r"(?m)^\s*\[\[\s*check\s*\.\s*layers\s*\]\]", text)]
    start = heads[group] if group < len(heads) else 0
    name = re.compile(r"(?m)^\s*name\s*=\s*").search(text, start)
    return text.count("\n", 0, name.end() if name else start) + 1


def load_rules(path: str) -> RuleSet:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_rules(f.read(), path)
    except OSError as e:
        raise RuleConfigError(path, str(e)) from None


def validate(rules: RuleSet, modules: DataFrame, path: str = "") -> None:
    """Raise for the first pattern that fits no module, or under strict layers the first module in no layer."""
    unknown = unknown_patterns(rules, modules)
    first = unknown.orderBy("no").first()
    if first:
        raise UnknownRuleModule(first.module, first.rule)
    if rules.strict:
        bare = uncovered(rules, modules).agg(F.min("path")).first()[0]
        if bare is not None:
            raise RuleConfigError(path, f"strict-layers: module '{bare}' is not assigned to any layer")


def scaffold(name: str, modules: DataFrame) -> str:
    """A first file of rules: one group of all top-level modules."""
    tops = [r[0] for r in modules.select(P.truncated(F.col("path"), 1)).distinct().orderBy(F.col("substring_index(path, ::, 1)")).collect()]
    order = ", ".join(f'"{t}"' for t in tops)
    return (
        "# Generated by `modgraph check --init`. Put the highest layer first in `order`:\n"
        "# a lower layer must not depend on a higher one. Split it into several groups as\n"
        "# needed; each is checked on its own, and a module may be in more than one.\n\n"
        f'[[check.layers]]\nname = "{name}"\norder = [{order}]\n'
    )


# ---- relational checks


def memberships(modules: DataFrame, rules: RuleSet) -> DataFrame:
    """(path, group_no, group_name, idx, deny_same): the most specific layer of each group, the higher one of a tie.

    Layers are subtrees, so a module meets them by an equi-join on its prefixes.
    """
    layers = F.broadcast(rules.layer_table(modules.sparkSession))  # as long as the file of rules
    told = modules.select("path").distinct().select("path", F.explode(F.concat(F.array(F.lit("")), P.prefixes(F.col("path")))).alias("base"))
    ranked = told.join(layers, "base").withColumn(
        "r", F.row_number().over(Window.partitionBy("path", "group_no").orderBy(F.desc("specificity"), "idx"))
    )
    return ranked.where("r = 1").select("path", "group_no", "group_name", "idx", "deny_same")


def layer_violations(edges: DataFrame, modules: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per edge and group that it goes up in, or sideways where that is denied to unrelated modules."""
    member = memberships(modules, rules)
    a = checked(member.select(F.col("path").alias("source"), "group_no", "group_name", F.col("idx").alias("i"), "deny_same"))
    b = checked(member.select(F.col("path").alias("target"), "group_no", F.col("idx").alias("j")))
    apart = ~P.related(F.col("source"), F.col("target"))
    rows = edges.join(a, "source").join(b, ["target", "group_no"])
    rows = rows.where((F.col("i") > F.col("j")) | ((F.col("i") == F.col("j")) & F.col("deny_same") & apart))
    how = F.when(F.col("i") > F.col("j"), "upward").otherwise("same-layer")
    rule = F.concat(
        F.lit("layer '"), "group_name", F.lit("' forbids "), how, F.lit(" dependency ("), "source", F.lit(" -> "), "target", F.lit(")")
    )
    return rows.select(F.lit("LAYER").alias("kind"), "source", "target", rule.alias("rule"), "apis")


def deny_violations(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per edge and deny rule that fits both ends.

    The rules, as many as the file has, are tested as one expression over each edge: no join and no pairs.
    """
    hits = [
        F.when(
            P.matches(F.col("source"), F.lit(d.source.base), F.lit(d.source.subtree))
            & P.matches(F.col("target"), F.lit(d.target.base), F.lit(d.target.subtree)),
            F.lit(str(d)),
        )
        for d in rules.deny
    ]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return edges.select(F.lit("DENY").alias("kind"), "source", "target", F.explode(found).alias("rule"), "apis")


def check(edges: DataFrame, modules: DataFrame, rules: RuleSet) -> DataFrame:
    """All violations (kind, source, target, rule, apis)."""
    return deny_violations(edges, rules).unionByName(layer_violations(edges, modules, rules))


def uncovered(rules: RuleSet, modules: DataFrame) -> DataFrame:
    """Modules that no layer has."""
    return modules.select("path").distinct().join(memberships(modules, rules), "path", "left_anti")


def unknown_patterns(rules: RuleSet, modules: DataFrame) -> DataFrame:
    """(no, module, rule) of patterns that fit no module, layers first, in the order of the file."""
    rows = [(p.base, p.subtree, p.base or "*", f"layers '{g.name}'") for g in rules.layers for p in g.order]
    rows += [(p.base, p.subtree, str(p), str(d)) for d in rules.deny for p in (d.source, d.target)]
    rows = [(n, *r) for n, r in enumerate(rows) if r[0]]
    spark = modules.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "no int, base string, subtree boolean, module string, rule string"))
    told = modules.select(F.explode(P.prefixes(F.col("path"))).alias("base"), "path")
    known = told.join(table, "base").where((F.col("path") == F.col("base")) | F.col("subtree")).select("no").distinct()
    return table.join(known, "no", "left_anti").select("no", "module", "rule")
