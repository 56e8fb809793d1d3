import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.functions.predicates import apply_rules, conjunction, expand, known_groups, retrieve, rules_text, ucq
from lucerna.functions.text import as_bool, items, map_items, serialised, without_comma
from lucerna.model import Config, FeatureSpec, Kind, Modality, Predicate, SemCQ, SemPredicate, TableRoles, normal_prompt, semantic_feature

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
ROWS = [(1, "a", 2.5), (2, None, None), (None, "", 0.0), (3, "b", -1.0), (4, "10", 7.25)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "k int, x int, s string, y double").cache()


def holds(p, row):
    value = row["xsy".index(p.field)]
    if p.field == "s":
        value = value or ""
    elif value is None:
        return p.op == "!=" and p.value != "" or p.op == "==" and p.value == ""
    elif p.value == "":
        return p.op == "!="
    return OPS[p.op](value, p.value)


numbers = st.builds(Predicate, st.sampled_from("xy"), st.sampled_from(list(OPS)), st.sampled_from([0, 1, 2, 2.5, 3]))
texts = st.builds(Predicate, st.just("s"), st.sampled_from(["==", "!="]), st.sampled_from(["", "a", "10"]))
blanks = st.builds(Predicate, st.sampled_from("xy"), st.sampled_from(["==", "!="]), st.just(""))


@settings(max_examples=40, deadline=None)
@given(groups=st.lists(st.lists(numbers | texts | blanks, max_size=3), max_size=3))
def test_unions_of_conjunctions(table, groups):
    want = {i for i, r in enumerate(ROWS) if not groups or any(all(holds(p, r) for p in g) for g in groups)}
    assert {r.k for r in retrieve(table, groups).collect()} == want


@settings(max_examples=30, deadline=None)
@given(rules=st.lists(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from([0.0, 1.5, 2.5]), st.sampled_from(["<=", ">"])), max_size=3), max_size=3))
def test_rules(table, rules):
    def hit(r):
        value = dict(zip("xsy", r))
        test = lambda f, t, op: value[f] is not None and (value[f] <= t if op == "<=" else value[f] > t)
        return int(any(all(test(*c) for c in rule) for rule in rules))

    assert {r.k: r.predicted for r in apply_rules(table, rules).collect()} == {i: hit(r) for i, r in enumerate(ROWS)}


def test_rules_on_texts_and_as_sql(table):
    assert {r.k for r in apply_rules(table, [[("s", "a", "<=")]]).filter("predicted = 1").collect()} == {0, 1, 2, 4}
    assert rules_text([]) == "FALSE" and rules_text([[]]) == "TRUE" and rules_text([[("x", 1.0, ">"), ("s", "a", "<=")]]) == "(x > 1 AND s <= 'a')"


def test_errors_and_normal_forms(table):
    with pytest.raises(ValueError):
        ucq([[Predicate("nothing", "==", 1)]], table.schema)
    with pytest.raises(ValueError):
        Predicate("x", "~", 1)
    with pytest.raises(ValueError):
        Predicate("x", "==", [1])
    assert len(expand(["a", "b"], "==", [1, 2])) == 4 and len(expand(["a", "b"], "!=", [1, 2])[0]) == 4 and expand(["a", "b"], ">", [1, 2]) == [[Predicate("a", ">", 1)]]
    assert len(conjunction([expand(["a"], "==", [1, 2]), expand(["b"], "==", [3, 4])])) == 4
    assert known_groups([[Predicate("x", "==", 1)], [Predicate("z", "==", 1)]], ["x"]) == [[Predicate("x", "==", 1)]]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "x, ,y"), (2, ""), (3, None), (4, " one ")], "k int, v string")
    assert {r.k: r.i for r in df.select("k", items(F.col("v")).alias("i")).collect()} == {1: ["x", "y"], 2: [], 3: [], 4: ["one"]}
    assert {r.k: r.h for r in map_items(df, "v", lambda x: x == "y", Kind.BOOL, "h").collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.k: r.n for r in map_items(df, "v", lambda x: F.length(x) + 1, Kind.INT, "n").collect()} == {1: 4, 2: 0, 3: 0, 4: 4}


def test_guards(spark):
    df = spark.createDataFrame([("true",), ("0",), (" TRUE ",)], "v string")
    assert [r[0] for r in df.select(as_bool(F.col("v"))).collect()] == [True, False, True]
    with pytest.raises(Exception, match="not Boolean"):
        spark.createDataFrame([("maybe",)], "v string").select(as_bool(F.col("v"))).collect()
    with pytest.raises(Exception, match="comma"):
        spark.createDataFrame([("a,b",)], "v string").select(without_comma(F.col("v"), "v")).collect()
    assert spark.createDataFrame([(1, None)], "a int, b string").select(serialised(["a", "b"])).first()[0] == "a: 1, b: "


def test_model():
    p = SemPredicate("t", "Text", "is  Nice", "Is it nice?")
    assert semantic_feature(p).target == semantic_feature(SemPredicate("t", "Text", "other", " is IT  nice?")).target and semantic_feature(p).mandatory
    assert normal_prompt(" A\n b ") == "a b" and FeatureSpec("t", "Text", "n", "q", "int").budget_key == ("derived", "t", "n", Kind.INT)
    assert SemCQ(["a"], [], [p]).semantics == (p,) and p.modality is Modality.TEXT
    assert TableRoles(("a",), ("i",), ("t",)).features(["t", "z", "i", "a", "b", "_x"]) == ["a", "b", "z"]
    with pytest.raises(ValueError):
        Kind.UNDEFINED.sql


@pytest.mark.parametrize("wrong", [{"delta": 1.0}, {"delta": True}, {"b_rew": 0}, {"b_lab": -1}, {"loo_step": 0}, {"enable_subj": 1}, {"dynamic_setting": []}, {"dynamic_setting": [0.5, 0.5]}, {"dynamic_setting": [0.5, 1.5]}, {"random_seed": 1.5}])
def test_configurations_are_checked(wrong):
    with pytest.raises(ValueError):
        Config(**wrong)


def test_configurations_are_whole():
    from dataclasses import asdict

    assert Config.parse(asdict(Config())) == Config()
    with pytest.raises(ValueError):
        Config.parse({"delta": 0.1})
