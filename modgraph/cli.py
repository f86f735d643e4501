"""The command line: list, use, deps, why and check, over one crate."""

from __future__ import annotations

import argparse
import logging
import os
import re
import sys

from pyspark.sql import SparkSession

from modgraph import __version__, render
from modgraph.analyzer import Analyzer, rendered
from modgraph.errors import AnalysisError
from modgraph.operators import graph, rules
from modgraph.storage import materialize

NAME = "modgraph"
MOST_CHARACTERS = 512
log = logging.getLogger(NAME)


def module_path(text: str) -> str:
    if not text:
        raise argparse.ArgumentTypeError("module path cannot be empty")
    if len(text) > MOST_CHARACTERS:
        raise argparse.ArgumentTypeError(f"module path is too long ({len(text)} characters, at most {MOST_CHARACTERS})")
    if not re.fullmatch(r"[A-Za-z0-9_:-]+", text):
        raise argparse.ArgumentTypeError("module path has invalid characters")
    if text.startswith("::") or text.endswith("::") or ":::" in text:
        raise argparse.ArgumentTypeError("module path must not start or end with '::' or have ':::'")
    return text


def depth(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("depth must be at least 1")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(NAME, description="Dependencies between the modules of a Rust crate.")
    top.add_argument("-p", "--path", default=".", dest="root", help="the crate's folder")
    top.add_argument("-v", action="count", default=0, dest="verbose")
    top.add_argument("-l", "--log-file")
    top.add_argument("--version", action="version", version=f"{NAME} {__version__}")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *aliases: str, formats: tuple[str, ...], **more) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, aliases=aliases, **more)
        p.set_defaults(run=name)
        p.add_argument("-t", "--include-tests", action="store_true")
        p.add_argument("-f", "--format", choices=formats, default="plain")
        return p

    p = verb("list", "ls", "l", formats=("plain", "table"), help="which modules are there?")
    p.add_argument("module", nargs="?", type=module_path)
    p.add_argument("-d", "--depth", type=depth)
    p.add_argument("-F", "--filter")
    p.add_argument("-s", "--show-source", action="store_true")
    p.add_argument("-V", "--show-visibility", action="store_true")
    p.add_argument("-T", "--targets", action="store_true")
    p = verb("use", "u", formats=("plain", "grouped"), help="what does a module refer to?")
    p.add_argument("module", type=module_path)
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-e", "--expand", action="store_true")
    p.add_argument("-d", "--depth", type=depth)
    p.add_argument("-G", "--resolve-globs", action="store_true")
    p = verb("deps", "d", "dependencies", formats=("plain", "grouped", "dot"), help="which modules depend on which?")
    p.add_argument("-d", "--depth", type=depth)
    p.add_argument("-a", "--show-apis", action="store_true")
    p.add_argument("--cycles", nargs="?", const="detect", choices=("detect", "highlight"))
    p.add_argument("--orphans", action="store_true")
    p.add_argument("--path", nargs=2, type=module_path, metavar=("SOURCE", "TARGET"), dest="ends")
    p = verb("why", "w", formats=("plain", "grouped"), help="which references make one module depend on another?")
    p.add_argument("source", type=module_path)
    p.add_argument("target", type=module_path)
    p.add_argument("-r", "--recursive", action="store_true")
    p = verb("check", "c", formats=("plain",), help="which dependencies break the rules?")
    p.add_argument("--init", action="store_true")
    p.add_argument("-c", "--config")
    p.add_argument("-a", "--show-apis", action="store_true")
    return top


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = parser()
    args = top.parse_args(argv)
    if args.run == "deps":
        if args.ends and (args.cycles or args.orphans or args.show_apis):
            top.error("--path cannot be used with --cycles, --orphans or --show-apis")
        if args.cycles and args.orphans:
            top.error("--cycles cannot be used with --orphans")
    return args


def session() -> SparkSession:
    """A session for one crate: small tables, so few partitions."""
    builder = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false")
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    """Print what was asked for; the exit code."""
    root = os.path.realpath(args.root)
    try:
        text, code = VERBS[args.run](Analyzer(spark, root), args)
    except AnalysisError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2 if args.run == "check" else 1
    sys.stdout.write(text)
    return code


def do_list(a: Analyzer, args) -> tuple[str, int]:
    found = a.list_modules(args.module, args.include_tests) if args.module else a.list_all_modules(args.include_tests)
    targets = args.targets or not args.module and len({m.target for m in found}) > 1
    if args.depth:
        found = [m for m in found if m.path.count("::") < args.depth]
    if args.filter is not None:
        found = [m for m in found if args.filter in m.path]
    if not found:
        log.info("No modules found.")
        return "", 0
    return render.listing(found, a.crate.root, args.format, args.show_source, args.show_visibility, targets), 0


def do_use(a: Analyzer, args) -> tuple[str, int]:
    refs = a.references(args.module, args.recursive, args.include_tests, args.expand, args.resolve_globs)
    groups: dict[str, list[str]] = {m.path: [] for m in a._tree(args.module, args.recursive, args.include_tests)}
    for r in rendered(refs, args.depth).select("source", "text").distinct().collect():
        groups[r.source].append(r.text)
    return render.references(groups, args.format, args.module), 0


def do_why(a: Analyzer, args) -> tuple[str, int]:
    groups: dict[str, list[str]] = {}
    for r in rendered(a.explain(args.source, args.target, args.recursive, args.include_tests)).select("source", "text").distinct().collect():
        groups.setdefault(r.source, []).append(r.text)
    if not groups:
        log.info("No references from '%s' to '%s'.", args.source, args.target)
    return render.reasons(groups, args.format), 0


def do_deps(a: Analyzer, args) -> tuple[str, int]:
    found = a.graph(args.include_tests, args.depth, args.show_apis)
    edges = materialize(found.edges)
    if args.ends:
        source, target = args.ends
        paths = [r.path for r in graph.checked_paths(edges, found.modules, source, target).collect()]
        paths = sorted(paths, key=lambda p: p if args.depth else " -> ".join(p))
        if not paths:
            print(f"No path from {source} to {target}.", file=sys.stderr)
        return render.paths(paths, render.sorted_edges(edges), args.format), 0
    if args.orphans:
        names = [r.path for r in graph.orphans(edges, found.modules).orderBy("path").collect()]
        if not names:
            print("No orphan modules found.", file=sys.stderr)
        return render.orphans(names), 0
    if args.cycles:
        members = materialize(graph.cycles(edges))
        parts: dict[int, tuple[list[str], list]] = {}
        for r in members.orderBy("cycle_id", "path").collect():
            parts.setdefault(r.cycle_id, ([], []))[0].append(r.path)
        for r in graph.cycle_edges(edges, members).orderBy("cycle_id", "source", "target").collect():
            parts[r.cycle_id][1].append((r.source, r.target, r.apis))
        if not parts:
            print("No dependency cycles found.", file=sys.stderr)
        elif args.cycles == "highlight" and args.format != "dot":
            print(f"warning: --cycles highlight has no effect with {args.format} format, showing cycles only", file=sys.stderr)
        return render.cycles([parts[k] for k in sorted(parts)], render.sorted_edges(edges), args.format, args.cycles == "highlight"), 0
    return render.deps(render.sorted_edges(edges), args.format), 0


def do_check(a: Analyzer, args) -> tuple[str, int]:
    if args.init:
        path = a.init_config(args.config, args.include_tests)
        again = f"{NAME} check -c {args.config}" if args.config else f"{NAME} check"
        print(f"Scaffolded {path}.\n\n  Put the modules in order: the highest layer first, the lowest last.\n  A lower layer must never depend on a higher one.\n  Then run `{again}`.", file=sys.stderr)
        return "", 0
    found = a.check(args.config, args.include_tests, args.show_apis).orderBy(*rules.VIOLATION_ORDER).collect()
    if not found:
        log.info("All architectural rules satisfied.")
    return render.violations(found, NAME), int(bool(found))


VERBS = {"list": do_list, "use": do_use, "why": do_why, "deps": do_deps, "check": do_check}


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    levels = (logging.WARNING, logging.INFO, logging.DEBUG)
    place = {"filename": args.log_file} if args.log_file else {"stream": sys.stderr}
    logging.basicConfig(level=levels[min(args.verbose, 2)] if not args.log_file else logging.INFO, format="%(levelname)s %(name)s: %(message)s", **place)
    return run(args, session())


if __name__ == "__main__":
    sys.exit(main())
