"""Results as text: plain lines, groups, an ASCII table, and Graphviz."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame

from modgraph.sources.rust.crate import Module

#: The look of Graphviz output.
HEAD = """digraph dependencies {
    rankdir=LR;
    node [shape=box, style=rounded, fontname="monospace", fontsize=10];
    edge [color="#444444"];
"""
API_COLOUR, CYCLE_COLOUR = "#c96a00", "#e67700"
PATH_STYLE = "color=red, style=bold, penwidth=2.0"
CYCLE_STYLE = f'color="{CYCLE_COLOUR}", style=bold, penwidth=2.0'

Edge = tuple[str, str, list[str]]


def sorted_edges(edges: DataFrame) -> list[Edge]:
    return [(r.source, r.target, r.apis) for r in edges.select("source", "target", "apis").orderBy("source", "target").collect()]


def lines(rows: Iterable[str]) -> str:
    return "".join(f"{r}\n" for r in rows)


def blocks(parts: Iterable[list[str]]) -> str:
    """Groups of lines with an empty line between them."""
    return "\n".join(lines(p) for p in parts)


def suffix(apis: list[str]) -> str:
    return f" [{', '.join(apis)}]" if apis else ""


def arrow(edge: Edge) -> str:
    return f"{edge[0]} -> {edge[1]}{suffix(edge[2])}"


# ---- dependencies


def deps(edges: list[Edge], form: str = "plain") -> str:
    if form == "dot":
        return dot(edges)
    if form == "plain":
        return lines(map(arrow, edges))
    groups: dict[str, list[Edge]] = {}
    for e in edges:
        groups.setdefault(e[0], []).append(e)
    return blocks([f"{s} ({len(g)})", *(f"  -> {t}{suffix(a)}" for _, t, a in g)] for s, g in groups.items())


def dot(edges: list[Edge], styles: dict[tuple[str, str], str] | None = None, apis: bool = True, before: str = "", nodes: list[str] | None = None) -> str:
    """A digraph; styles: attributes of single edges; before: text above the nodes; nodes: those to name, or all."""
    out = HEAD + before
    if nodes is None:
        nodes = sorted({n for e in edges for n in e[:2]})
    if nodes:
        out += "\n" + lines(f'    "{n}";' for n in nodes)
    if edges:
        out += "\n"
    for source, target, names in edges:
        told = [styles[source, target]] if styles and (source, target) in styles else []
        if apis and names:
            told.append(f'label="{", ".join(names)}", fontcolor="{API_COLOUR}"')
        out += f'    "{source}" -> "{target}"' + (f" [{', '.join(told)}]" if told else "") + ";\n"
    return out + "}\n"


# ---- cycles: [(modules, edges)]


def cycles(found: list[tuple[list[str], list[Edge]]], edges: list[Edge], form: str = "plain", highlight: bool = False) -> str:
    if not found:
        return ""
    if form == "dot":
        boxes = ""
        for n, (modules, _) in enumerate(found, 1):
            inside = "".join(f'        "{m}";\n' for m in modules)
            boxes += (
                f'\n    subgraph cluster_cycle_{n} {{\n        label="cycle {n} ({len(modules)} modules)";\n        style=dashed;\n'
                f'        color="{CYCLE_COLOUR}";\n        fontcolor="{CYCLE_COLOUR}";\n{inside}    }}\n'
            )
        own = [e for _, part in found for e in part]
        styles = {e[:2]: CYCLE_STYLE for e in own}
        if not highlight:
            return dot(own, styles, before=boxes, nodes=[])
        members = {m for modules, _ in found for m in modules}
        return dot(edges, styles, before=boxes, nodes=sorted({n for e in edges for n in e[:2]} - members))
    names = (lambda modules: f": {', '.join(modules)}") if form == "grouped" else (lambda modules: "")
    return blocks([f"cycle {n} ({len(m)} modules){names(m)}", *(f"  {arrow(e)}" for e in part)] for n, (m, part) in enumerate(found, 1))


# ---- paths, orphans, references


def paths(found: list[list[str]], edges: list[Edge], form: str = "plain") -> str:
    if not found:
        return ""
    if form == "dot":
        styles = {pair: PATH_STYLE for p in found for pair in zip(p, p[1:])}
        return dot(edges, styles, apis=False)
    if form == "plain":
        return lines(" -> ".join(p) for p in found)
    lengths = sorted({len(p) - 1 for p in found})
    return blocks([f"length {n}:", *("  " + " -> ".join(p) for p in found if len(p) - 1 == n)] for n in lengths)


def orphans(found: list[str]) -> str:
    return lines(found)


def references(groups: dict[str, list[str]], form: str, name: str) -> str:
    """Of ``use``: all references once, or under each module, also one without any; name: what the root is called."""
    if form == "plain":
        return lines(sorted({t for g in groups.values() for t in g}))
    return lines(line for m in sorted(groups) for line in (m or name, *(f" - {t}" for t in sorted(set(groups[m])))))


def reasons(groups: dict[str, list[str]], form: str) -> str:
    """Of ``why``."""
    if form == "plain":
        return lines(sorted({t for g in groups.values() for t in g}))
    return blocks([m, *(f"  {t}" for t in sorted(groups[m]))] for m in sorted(groups))


# ---- listings


def listing(modules: list[Module], root: str, form: str, source: bool, visibility: bool, targets: bool) -> str:
    """Modules, one a line, with the columns asked for; the last column is not padded."""
    short = lambda m: os.path.relpath(m.file, root) if m.file.startswith(root + os.sep) else m.file
    tag = (lambda m: f"[{m.target}]") if form == "plain" else (lambda m: str(m.target))
    asked = [("Target", tag, targets), ("Module", lambda m: m.path, True), ("Visibility", lambda m: m.visibility, visibility), ("File", short, source)]
    columns = [(head, cell) for head, cell, wanted in asked if wanted]
    rows = [[cell(m) for _, cell in columns] for m in modules]
    if form == "table":
        return table([head for head, _ in columns], rows)
    if not rows:
        return ""
    widths = [max(map(len, column)) for column in zip(*rows)]
    if not (source or visibility or targets):
        return lines(r[0] for r in rows)
    at = int(targets)  # the column of the module
    out = []
    for r in rows:
        head = f"{r[0]:<{widths[0]}} " if targets else ""
        rest = r[at:]
        cells = [f"{c:<{w}}" for c, w in zip(rest[:-1], widths[at:-1])] + rest[-1:]
        out.append(head + "  ".join(cells))
    return lines(out)


def table(head: list[str], rows: list[list[str]]) -> str:
    """A table with ASCII borders, a double line under the head and a line between rows."""
    widths = [max(map(len, column)) for column in zip(head, *rows)]
    dashes = ["-" * (w + 2) for w in widths]
    row = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths)) + "|"
    edge = "+" + "+".join(dashes) + "+"
    out = [edge, row(head), "+" + "=" * (len(edge) - 2) + "+"]
    for n, r in enumerate(rows):
        out += ["|" + "+".join(dashes) + "|"] * bool(n) + [row(r)]
    return lines([*out, edge])


# ---- violations


def violations(found: list, name: str) -> str:
    if not found:
        return ""
    head = f"{name} check: {len(found)} violation{'s' * (len(found) > 1)}\n\n"
    return head + lines(f"  {v.kind} {v.source} -> {v.target}{suffix(v.apis)}   (rule: {v.rule})" for v in found)
