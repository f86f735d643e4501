"""Rust sources: lexing, parsing, discovery, references, and the command line, on crates written here."""

import pytest

from modgraph import cli, render
from modgraph.analyzer import Analyzer, rendered
from modgraph.errors import CrateInfoError, ModuleAnalysisFailed, ModuleNotFound, UndeclaredModule
from modgraph.sources.rust.crate import Module, Target, targets_of
from modgraph.sources.rust.items import parse_file
from modgraph.sources.rust.lexer import LexError, token_trees


def names(tokens):
    return [t.text for t in tokens if t.kind == "i"]


def test_lexer():
    text = '''#!/usr/bin/env x
    /* a /* nested */ b */ let r#type = r##"quote " # "##; let c = 'x'; let l: &'static str = b"\\""; 1..2; 1.0e-3; // end
    '\\u{1F600}' 'a' f::<'b>(x)'''
    assert names(token_trees(text)) == ["let", "type", "let", "c", "let", "l", "str", "f"]
    for bad in ("fn a( {", "}", '"open', "/* open", 'r#"open"', "`"):
        with pytest.raises(LexError):
            token_trees(bad)


def refs(text, kind=None, package=None, scope=0):
    return [(r.prefix, r.levels, "::".join(r.segments), r.suffix_text) for r in parse_file(text, package)[scope].references if kind in (None, r.kind)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("use crate::a::B;", [("crate", 0, "a::B", "")]),
        ("use super::super::a;", [("super", 2, "a", "")]),
        ("use self::a::*;", [("self", 0, "a", "*")]),
        ("use crate::*;", [("crate", 0, "", "*")]),
        ("pub use crate::a as b;", [("crate", 0, "a", "b")]),
        ("use crate::a::{self, B as C, d::{E, f::*}, g::H, i::J as K};", [("crate", 0, "a", "{self, B as C, d::{E, f::{*}}, g::H, i::{J as K}}")]),
        ("use {crate::a, std::b};", [("none", 0, "", "{crate::a, std::b}")]),
        ("use std::fmt;", [("none", 0, "std::fmt", "")]),
    ],
)
def test_use(text, want):
    assert refs(text, "use") == want


def test_leaves_of_groups():
    r = parse_file("use crate::a::{self, B as C, d::{E, f::*, self}, g::self};")[0].references[0]
    assert r.leaves == [(["a"], False, ""), (["a", "B"], False, ""), (["a", "d", "E"], False, ""), (["a", "d", "f"], False, "{*}"), (["a", "d"], False, ""), (["a", "g", "self"], False, "")]
    assert parse_file("use crate::{a::{B, *}};")[0].references[0].leaves[1] == (["a"], False, "{B, *}")


def test_paths_in_code():
    text = """
    #[derive(Debug)] pub struct S<T: crate::tr::Bound> { field: crate::ty::F<Vec<crate::ty::G>>, parser: u8 }
    impl crate::tr::T for S where crate::w::X: Clone {
        fn f(&self, cache: u8) -> Vec<crate::ret::R> {
            let x = crate::val::make::<crate::gen::P>(1).cache(2);
            if a < b && c > d {}
            match y { crate::pat::P { z } => child, crate::pat::Q(w) => other::thing }
            crate::mac::m!(crate::arg::A, local::b);
            <crate::q::S as crate::q::Tr>::method();
            crate::assoc::Type::<u8>::new()
        }
    }"""
    got = {p for _, _, p, _ in refs(text)}
    for want in ("tr::Bound", "ty::F", "ty::G", "tr::T", "w::X", "ret::R", "val::make", "gen::P", "pat::P", "pat::Q", "other::thing", "mac::m", "arg::A", "q::S", "q::Tr::method", "assoc::Type::new", "child"):
        assert want in got, want
    assert not got & {"field", "parser", "cache", "f", "x", "S<T"}


def test_tokens_go_through_imports_seen_before():
    text = "fn a() { m!(v::X); } use crate::version as v; fn b() { m!(v::Y, std::z); } #[at(v::Z)] fn c() {}"
    via = [(r.segments, r.via) for r in parse_file(text)[0].references if r.kind == "token"]
    assert via == [(["v", "X"], None), (["v", "Y"], ("crate", 0, ["version", "Y"])), (["std", "z"], None), (["v", "Z"], ("crate", 0, ["version", "Z"]))]
    assert parse_file("use pkg::v; fn a() { m!(v::X) }", "pkg")[0].references[2].via == ("none", 0, ["pkg", "v", "X"])


def test_modules_and_items():
    text = """
    pub mod a { pub(super) mod b; pub(in crate::x) struct C; }
    #[cfg(all(unix, test))] mod t {} #[cfg(not(test))] mod n {} #[cfg(test)] mod u;
    pub(self) fn f() {} pub(crate) const K: u8 = { 1 }; static mut S: [u8; 2] = [1; 2]; pub type T = u8; pub union U { a: u8 }
    extern crate core as c; extern "C" { fn ext(); } macro_rules! mm { () => {} } trait Al = Clone; pub use a::b::{D, e::*, F as G};
    pub unsafe extern "C" fn ffi() {} pub const fn cf() {} pub async fn af() {}
    """
    top, a, t, n = parse_file(text)
    assert [(m[0], m[1], m[3], m[4]) for m in top.modules] == [("a", "public", False, True), ("t", "inherited", True, True), ("n", "inherited", False, True), ("u", "inherited", True, False)]
    assert a.path == ("a",) and a.modules == [("b", "super", "", False, False)] and a.items[1] == ("C", "struct", "in", "crate::x")
    items = {i[0]: i[1:3] for i in top.items}
    assert items["f"] == ("fn", "inherited") and items["K"] == ("const", "crate") and items["S"] == ("static", "inherited")
    assert {"T", "U", "core", "Al", "D", "G", "ffi", "cf", "af"} <= items.keys() and "mm" not in items and "ext" not in items
    for bad in ("mod", "fn f(", "struct S", "use ;", "pub 1", "impl X"):
        with pytest.raises(LexError):
            parse_file(bad)


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


FILES = {
    "Cargo.toml": '[package]\nname = "demo"\nversion = "0.1.0"\n',
    "src/lib.rs": "pub mod model; mod engine; pub mod util; #[cfg(test)] mod tests { use super::*; use crate::model::Row; } mod gone;\npub(crate) mod shapes { pub mod round { pub struct Circle; pub(super) struct Half; struct Hidden; pub(in crate::engine) struct Inner; } use self::round::Circle; pub mod outer; }\nuse model::Row;",
    "src/model.rs": "pub struct Row; pub(crate) struct Cell; use crate::util::text; use crate::util::text::{self, trim as cut}; fn f() { engine_like(); log!(\"{}\", text::JOIN); }",
    "src/engine/mod.rs": "mod plan; pub mod exec; use crate::model::*; use crate::shapes::round::*; pub fn go() { plan::build(); exec::run(); }",
    "src/engine/plan.rs": "use super::exec::Task; pub fn build() -> crate::model::Row { crate::Root::new() }",
    "src/engine/exec.rs": "use super::plan; pub struct Task; pub fn run(x: crate::util::Tool) {}",
    "src/util.rs": "pub mod text; pub struct Tool; use crate::missing::Thing;",
    "src/util/text.rs": "pub const JOIN: u8 = 1; pub fn trim() {}",
    "src/shapes/outer.rs": "use crate::shapes::round::Circle;",
    "src/main.rs": "mod cli; use demo::model::Row; fn main() { cli::start(); demo::engine::go(); }",
    "src/cli.rs": "use demo::util::{text, Tool}; pub fn start() {}",
    "tests/it.rs": "mod helper; use demo::model::Row;",
    "tests/helper/mod.rs": "use demo::util::Tool;",
}


@pytest.fixture(scope="module")
def crate(spark, tmp_path_factory):
    return Analyzer(spark, write(tmp_path_factory.mktemp("demo"), FILES))


def test_targets(tmp_path):
    root = write(tmp_path, {**FILES, "src/bin/tool.rs": "fn main() {}", "src/bin/big/main.rs": "fn main() {}", "examples/e.rs": ""})
    name, found = targets_of(root)
    assert name == "demo"
    assert [(t.kind, t.name, t.root_name) for t in found] == [("lib", "demo", "lib"), ("bin", "big", "main"), ("bin", "demo", "main"), ("bin", "tool", "tool"), ("test", "it", "it")]
    with pytest.raises(CrateInfoError, match="workspace support is not yet implemented"):
        targets_of(write(tmp_path / "ws", {"Cargo.toml": '[workspace]\nmembers = ["a"]'}))
    with pytest.raises(CrateInfoError, match="could not find"):
        targets_of(str(tmp_path / "none"))


def test_listing(crate):
    got = [(str(m.target), m.path, m.visibility) for m in crate.list_all_modules()]
    lib = [("engine", ""), ("engine::exec", "pub"), ("engine::plan", ""), ("lib", "pub"), ("model", "pub"), ("shapes", "pub(crate)"), ("shapes::outer", "pub"), ("shapes::round", "pub"), ("util", "pub"), ("util::text", "pub")]
    assert got == [("lib", *m) for m in lib] + [("bin:demo", "cli", ""), ("bin:demo", "main", "pub")]
    assert [m.path for m in crate.list_all_modules(True)][-2:] == ["helper", "it"]
    assert [m.path for m in crate.list_modules("engine")] == ["engine", "engine::exec", "engine::plan"]
    assert [m.path for m in crate.list_modules("lib", True) if "test" in m.path] == ["tests"]
    assert [m.path for m in crate.list_modules("helper", True)] == ["helper"]
    with pytest.raises(UndeclaredModule, match="Module 'nope' not found"):
        crate.list_modules("nope")
    with pytest.raises(ModuleNotFound, match="Module not found: nope"):
        crate.list_modules("nope", True)


def texts(df, depth=None):
    return sorted({r.text for r in rendered(df, depth).collect()})


def test_references(crate):
    assert texts(crate.references("model")) == ["crate::util::text", "crate::util::text::JOIN", "crate::util::text::{self, trim as cut}"]
    assert texts(crate.references("model", expand=True)) == ["crate::util::text", "crate::util::text::JOIN", "crate::util::text::trim"]
    assert texts(crate.references("engine")) == ["crate::engine::exec::run", "crate::engine::plan::build", "crate::model::*", "crate::shapes::round::*"]
    assert texts(crate.references("engine", recursive=True), 1) == ["crate::Root", "crate::engine", "crate::model", "crate::model::*", "crate::shapes", "crate::util"]
    assert texts(crate.references("lib")) == ["crate::model::Row"]
    assert texts(crate.references("shapes")) == ["crate::shapes::round::Circle"]
    assert texts(crate.references("main")) == ["crate::cli::start", "demo::model::Row"]


def test_globs(crate):
    got = texts(crate.references("engine", expand=True, globs=True))
    assert got == ["crate::engine::exec::run", "crate::engine::plan::build", "crate::model::Cell", "crate::model::Row", "crate::shapes::round::Circle", "crate::shapes::round::Inner"]


def edges(g):
    return sorted((r.source, r.target) for r in g.edges.collect())


def test_graph(crate):
    found = crate.graph()
    got = edges(found)
    assert ("engine::exec", "engine::plan") in got and ("engine::plan", "engine::exec") in got
    assert {("lib", "model"), ("model", "util::text"), ("main", "cli"), ("main", "model"), ("cli", "util"), ("cli", "util::text"), ("util", "lib"), ("engine::plan", "lib")} <= set(got)
    assert edges(crate.graph(depth=1)) == sorted({(a.split("::")[0], b.split("::")[0]) for a, b in got if a.split("::")[0] != b.split("::")[0]})
    apis = {(r.source, r.target): r.apis for r in crate.graph(apis=True).edges.collect()}
    assert apis["model", "util::text"] == ["JOIN", "trim"] and apis["util", "lib"] == ["missing::Thing"]
    assert ("helper", "util") in edges(crate.graph(tests=True))


def test_explain(crate):
    assert texts(crate.explain("model", "util::text")) == ["crate::util::text", "crate::util::text::JOIN", "crate::util::text::trim"]
    assert texts(crate.explain("engine", "model", recursive=True)) == ["crate::model::*", "crate::model::Row"]
    assert texts(crate.explain("model", "unknown")) == [] == texts(crate.explain("unknown", "unknown"))
    assert texts(crate.explain("util", "lib")) == ["crate::missing::Thing"]


def test_a_broken_file(spark, tmp_path):
    root = write(tmp_path, {"Cargo.toml": '[package]\nname = "b"\n', "src/lib.rs": "mod bad;", "src/bad.rs": "fn ("})
    with pytest.raises(CrateInfoError, match="Failed to parse file"):
        Analyzer(spark, root).list_all_modules()
    with pytest.raises(ModuleAnalysisFailed, match="Error analyzing module 'bad'"):
        Analyzer(spark, root).references("bad")


def call(spark, capsys, root, *argv):
    code = cli.run(cli.arguments(["-p", root, *argv]), spark)
    return code, *capsys.readouterr()


def test_command_line(spark, crate, capsys, tmp_path):
    root = crate.crate.root
    code, out, _ = call(spark, capsys, root, "list", "-d", "1", "-V")
    assert code == 0 and out.splitlines()[0] == "[lib]      engine  " and "[bin:demo] main    pub" in out
    assert call(spark, capsys, root, "ls", "util", "-s")[1] == "util        src/util.rs\nutil::text  src/util/text.rs\n"
    assert call(spark, capsys, root, "list", "util", "-f", "table")[1].splitlines()[:3] == ["+------------+", "| Module     |", "+============+"]
    assert call(spark, capsys, root, "use", "util", "-r", "-f", "grouped")[1] == "util\n - crate::missing::Thing\nutil::text\n"
    assert call(spark, capsys, root, "why", "model", "util::text", "-f", "grouped")[1] == "model\n  crate::util::text\n  crate::util::text::JOIN\n  crate::util::text::trim\n"
    assert call(spark, capsys, root, "deps", "--path", "main", "util::text")[1] == "main -> cli -> util::text\nmain -> model -> util::text\n"
    assert call(spark, capsys, root, "deps", "--path", "util::text", "main")[::2] == (0, "No path from util::text to main.\n")
    assert call(spark, capsys, root, "deps", "--path", "none", "main")[::2] == (1, "Error: Module not found: none\n")
    assert "main\n" in call(spark, capsys, root, "deps", "--orphans")[1]
    assert call(spark, capsys, root, "deps", "--cycles")[1].startswith("cycle 1 (")
    assert call(spark, capsys, root, "check")[0] == 2
    rules = tmp_path / "r.toml"
    rules.write_text('[[check.layers]]\nname = "app"\norder = ["util", "model"]')
    code, out, _ = call(spark, capsys, root, "check", "-c", str(rules))
    assert code == 1 and out == "modgraph check: 1 violation\n\n  LAYER model -> util::text   (rule: layer 'app' forbids upward dependency (model -> util::text))\n"
    rules.write_text('[[check.layers]]\nname = "app"\norder = ["model", "util"]')
    assert call(spark, capsys, root, "check", "-c", str(rules))[:2] == (0, "")
    fresh = tmp_path / "new.toml"
    assert call(spark, capsys, root, "check", "--init", "-c", str(fresh))[0] == 0 and 'name = "demo"' in fresh.read_text()
    assert call(spark, capsys, root, "check", "--init", "-c", str(fresh))[0] == 2
    for bad in (["deps", "--cycles", "--orphans"], ["use", "a:::b"], ["use", "::a"], ["list", "-d", "0"], ["deps", "--path", "a", "b", "-a"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_rendering():
    edges = [("a", "b", ["X", "Y"]), ("a", "c", []), ("b", "a", [])]
    assert render.deps(edges) == "a -> b [X, Y]\na -> c\nb -> a\n"
    assert render.deps(edges, "grouped") == "a (2)\n  -> b [X, Y]\n  -> c\n\nb (1)\n  -> a\n"
    assert render.deps([], "dot") == render.HEAD + "}\n"
    assert '    "a" -> "b" [label="X, Y", fontcolor="#c96a00"];' in render.deps(edges, "dot")
    found = [(["a", "b"], [edges[0], edges[2]])]
    assert render.cycles(found, edges, "grouped") == "cycle 1 (2 modules): a, b\n  a -> b [X, Y]\n  b -> a\n"
    shown = render.cycles(found, edges, "dot", highlight=True)
    assert '    subgraph cluster_cycle_1 {' in shown and '\n    "c";\n' in shown and '    "a" -> "c";\n' in shown
    assert '    "b" -> "a" [color="#e67700", style=bold, penwidth=2.0];' in shown
    assert render.cycles([], edges) == "" and render.orphans([]) == ""
    assert render.paths([["a", "b"]], edges, "grouped") == "length 1:\n  a -> b\n"
    assert '    "a" -> "b" [color=red, style=bold, penwidth=2.0];' in render.paths([["a", "b"]], edges, "dot")
    m = Module("x", "/r/src/x.rs", (), "", Target("bin", "t", "/r/src/main.rs"))
    assert render.listing([m], "/r", "table", True, False, True).splitlines()[1] == "| Target | Module | File     |"


def test_large_files_are_errors(spark, tmp_path, monkeypatch):
    from modgraph.sources.rust import crate as source

    (tmp_path / "src").mkdir()
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "big"\n')
    (tmp_path / "src/lib.rs").write_text("pub mod a;\npub mod b;\n")
    (tmp_path / "src/a.rs").write_text("use crate::b::X;\n")
    (tmp_path / "src/b.rs").write_text("pub struct X;\n// " + "x" * 200)
    monkeypatch.setattr(source, "MOST_BYTES", 100)
    with pytest.raises(CrateInfoError, match=r"b.rs' is too large: 217 bytes \(limit: 100 bytes\)"):
        Analyzer(spark, str(tmp_path)).list_all_modules()
    sources = spark.createDataFrame([("/c/src/lib.rs", "mod a;"), ("/c/src/a.rs", "// " + "y" * 100)], "file string, text string")
    of_table = source.Crate.of_sources(spark, "c", [Target("lib", "c", "/c/src/lib.rs")], sources)
    with pytest.raises(CrateInfoError, match="too large: 103 bytes"):
        Analyzer(spark, of_table).list_all_modules()


def test_links_out_of_the_crate(spark, tmp_path):
    (tmp_path / "c/src").mkdir(parents=True)
    (tmp_path / "out.rs").write_text("pub struct X;\n")
    (tmp_path / "c/Cargo.toml").write_text('[package]\nname = "c"\n')
    (tmp_path / "c/src/lib.rs").write_text("pub mod a;\n")
    (tmp_path / "c/src/a.rs").symlink_to(tmp_path / "out.rs")
    with pytest.raises(CrateInfoError, match="Resolved path escapes crate root"):
        Analyzer(spark, str(tmp_path / "c")).list_modules("a")


def test_names_bound_in_patterns_are_no_references():
    text = """fn f(x: T) -> U {
        let util = 1; let (util, model): (crate::a::A, u8) = g(util::two); if let Some(util) = x {} while let crate::b::B(util, ..) = x {}
        for (util, crate::c::C { model, .. }) in crate::d::all() { util::three(); }
        match x { util => one(), Some(util) | crate::e::E { util, model: None } if util::ok() => { four::five }, util @ 1..=crate::h::MAX => model,
            #[with(util::six)] util::K => model::seven(|util| util), Wrap(util) => Wrap(model), _ => util!(eight::nine) }
    }
    impl crate::i::I for crate::j::J { fn g<F>(f: F) where F: for<'a> crate::k::K<'a> {} }"""
    got = {"::".join(r.segments) for r in parse_file(text)[0].references}
    assert {"a::A", "b::B", "c::C", "d::all", "e::E", "h::MAX", "i::I", "j::J", "k::K", "util::two", "util::three", "util::ok", "four::five", "util::six", "util::K", "model::seven", "eight::nine"} <= got
    assert "Wrap" in got and "Some" in got
    # ``model`` stands alone as the value of an arm and in a call, ``util`` as the condition's and the loop's path alone and in a closure
    alone = [r.segments[0] for r in parse_file(text)[0].references if len(r.segments) == 1 and r.kind == "path"]
    assert alone.count("model") == 2 and "K" not in alone and "MAX" not in alone


def test_counts_of_a_graph(crate):
    found = crate.graph()
    assert found.edge_count() == len(edges(found)) and found.module_count() == found.modules.count() and not found.is_empty()
