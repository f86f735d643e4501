import pytest

from modgraph.errors import RuleConfigError, UnknownRuleModule
from modgraph.operators import rules

EDGES = [("till", "kitchen"), ("till", "cellar::wine"), ("kitchen", "cellar::wine"), ("kitchen", "pantry"), ("market", "lib"), ("pantry", "market"), ("cellar::door", "cellar::rack"), ("cellar::rack", "cellar::wine")]
MODULES = ["lib", "till", "kitchen", "pantry", "market", "cellar", "cellar::door", "cellar::rack", "cellar::wine"]


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame([(a, b, []) for a, b in EDGES], "source string, target string, apis array<string>")
    return edges, spark.createDataFrame([(m,) for m in MODULES], "path string")


def found(tables, text):
    got = rules.check(*tables, rules.parse_rules(text)).orderBy(*rules.VIOLATION_ORDER).collect()
    return [(r.kind, r.source, r.target) for r in got]


def test_downward_edges_are_clean(tables):
    assert found(tables, '[[check.layers]]\nname = "app"\norder = ["till", "kitchen", "pantry", "market"]') == []


def test_reversed_layers_break_every_edge(tables):
    got = found(tables, '[[check.layers]]\nname = "app"\norder = ["market", "pantry", "kitchen", "till"]')
    assert got == [("LAYER", "kitchen", "pantry"), ("LAYER", "pantry", "market"), ("LAYER", "till", "kitchen")]


def test_each_group_reports(tables):
    text = '[[check.layers]]\nname = "left"\norder = ["pantry", "kitchen"]\n[[check.layers]]\nname = "right"\norder = ["pantry", "kitchen", "market"]'
    assert found(tables, text) == [("LAYER", "kitchen", "pantry")] * 2


def test_deny(tables):
    text = '[check]\n[[check.deny]]\nfrom = "till"\nto = "cellar::*"\n[[check.deny]]\nfrom = "till"\nto = "cellar"'
    assert found(tables, text) == [("DENY", "till", "cellar::wine")]


def test_same_layer_spares_relatives(spark, tables):
    text = '[check]\ndeny-same-layer = true\n[[check.layers]]\nname = "w"\norder = ["cellar"]'
    assert found(tables, text) == [("LAYER", "cellar::door", "cellar::rack"), ("LAYER", "cellar::rack", "cellar::wine")]
    edges = spark.createDataFrame([("cellar", "cellar::door", []), ("cellar::door", "cellar", [])], "source string, target string, apis array<string>")
    assert rules.check(edges, tables[1], rules.parse_rules(text)).count() == 0


def test_the_most_specific_layer_counts(tables):
    text = '[[check.layers]]\nname = "g"\norder = ["cellar::door", "*", "cellar"]'
    got = {r.path: r.idx for r in rules.memberships(tables[1], rules.parse_rules(text)).collect()}
    assert got["cellar::door"] == 0 and got["cellar::rack"] == 2 and got["till"] == 1


def test_messages(tables):
    one = rules.check(*tables, rules.parse_rules('[[check.layers]]\nname = "app"\norder = ["pantry", "kitchen"]')).first()
    assert one.rule == "layer 'app' forbids upward dependency (kitchen -> pantry)"
    assert str(rules.parse_rules('[check]\n[[check.deny]]\nfrom = "a::*"\nto = "*"').deny[0]) == "deny a::* -> *"


def test_validation(tables):
    modules = tables[1]
    rules.validate(rules.parse_rules('[[check.layers]]\nname = "g"\norder = ["cellar", "*"]\n[[check.deny]]\nfrom = "*"\nto = "cellar::*"'), modules)
    with pytest.raises(UnknownRuleModule, match=r"Rule references unknown module 'nope' \(in rule 'layers 'g''\)"):
        rules.validate(rules.parse_rules('[[check.layers]]\nname = "g"\norder = ["cellar", "nope::*"]'), modules)
    with pytest.raises(UnknownRuleModule, match=r"'gone::\*' \(in rule 'deny till -> gone::\*'\)"):
        rules.validate(rules.parse_rules('[check]\n[[check.deny]]\nfrom = "till"\nto = "gone::*"'), modules)
    with pytest.raises(RuleConfigError, match="strict-layers: module 'kitchen' is not assigned to any layer"):
        rules.validate(rules.parse_rules('[check]\nstrict-layers = true\n[[check.layers]]\nname = "g"\norder = ["cellar", "till"]'), modules)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("", "missing field `check`"),
        ("[check]\nodd = 1", "unknown field `odd`"),
        ("[other]", "unknown field `other`"),
        ("[check", "Expected"),
        ('[[check.layers]]\nname = "a"\norder = "x"', "invalid type of `order`"),
        ('[[check.layers]]\nname = "a"\norder = []\n\n[[check.layers]]\norder = []\nname = "a"', r"duplicate layer group name 'a' \(line 7\)"),
        ('[[check.deny]]\nfrom = "a"', "missing field `to`"),
    ],
)
def test_bad_configurations(text, reason):
    with pytest.raises(RuleConfigError, match=reason):
        rules.parse_rules(text, "f.toml")


def test_config_files(spark, tables, tmp_path):
    with pytest.raises(RuleConfigError, match="no modgraph.toml or .modgraph.toml found"):
        rules.config_path(str(tmp_path))
    with pytest.raises(RuleConfigError, match="config file does not exist"):
        rules.config_path(str(tmp_path), str(tmp_path / "x.toml"))
    (tmp_path / ".modgraph.toml").write_text("[check]")
    assert rules.config_path(str(tmp_path)).endswith("/.modgraph.toml")
    (tmp_path / "modgraph.toml").write_text(rules.scaffold("demo", tables[1]))
    with pytest.warns(UserWarning):
        path = rules.config_path(str(tmp_path))
    loaded = rules.load_rules(path)
    assert [p.base for p in loaded.layers[0].order] == ["cellar", "kitchen", "lib", "market", "pantry", "till"]
    assert rules.RuleSet().layer_table(spark).count() == 0 and rules.check(*tables, rules.RuleSet()).count() == 0
