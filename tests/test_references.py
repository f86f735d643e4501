from modgraph.functions import references as R
from modgraph.functions.references import GroupItem, Reference


def test_texts():
    r = Reference.of("a", "B")
    assert str(r) == "a::B" and str(r.with_crate_prefix()) == "crate::a::B" and str(r.with_self_prefix().with_alias("C")) == "self::a::B as C"
    assert str(r.with_super(2).with_glob()) == "super::super::a::B::*" and str(Reference.of().with_crate_prefix().with_glob()) == "crate::*"
    nested = GroupItem.nested(["io"], [GroupItem.of("Read")])
    braces = GroupItem.nested(("x",), [GroupItem.of("*")])
    aliased = GroupItem("alias", "P", "Q")
    assert str(r.with_group([GroupItem.of("self"), nested, braces, aliased, GroupItem.nested(["e"], [])])) == "a::B::{self, io::Read, x::{*}, P as Q, e}"
    assert [GroupItem.of(t).kind for t in ("*", "self", "selfish")] == ["glob", "self", "simple"]


def test_accessors(spark):
    r = Reference.of("serde", "de")
    assert not r.is_relative and r.is_from_crate("serde") and not r.with_crate_prefix().is_from_crate("serde")
    assert r.final_name == "de" and r.with_alias("d").final_name == "d" and Reference.of().final_name is None
    assert str(r.with_glob().truncated(1)) == "serde" and r.with_glob().truncated(2) == r.with_glob()
    rows = [("none", ["serde", "de"], "none", ""), ("crate", ["a"], "alias", "b"), ("self", [], "glob", "*"), ("none", [], "group", "{a}")]
    table = spark.createDataFrame(rows, "prefix string, segments array<string>, suffix string, suffix_text string")
    got = table.select(R.is_relative(), R.is_from_crate("serde"), R.has_glob(), R.has_group(), R.final_name()).collect()
    assert [tuple(x) for x in got] == [(False, True, False, False, "de"), (True, False, False, False, "b"), (True, False, True, False, None), (False, False, False, True, None)]
