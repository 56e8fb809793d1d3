import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.model import FeatureSpec, Predicate, SemCQ, SemPredicate, semantic_feature
from lucerna.operators import buckets as B
from lucerna.operators.batches import ladder, ranked, sample, with_batches
from lucerna.operators.builders import concat_distinct, left_chain
from lucerna.operators.certify import certificate, f1_bound, hypergeometric_cdf, most_errors, reoptimisation_threshold, split_annotations, updated_certificate
from lucerna.operators.confidence import class_distance, select_balanced, select_empirical, structural_probability
from lucerna.operators.features import FeatureCache, accepted, active_columns, predicate_budgets, rank_features, sync_columns, table_fingerprint, with_mandatory
from lucerna.operators.forest import ForestConfig, choose_depth, leave_one_out, subjective_error, train
from lucerna.operators.quality import Quality, bucket_quality, quality, symmetric_difference
from lucerna.operators.rewrite import arity, best_candidate, candidates, extract_rules, grow_leaves, least_prefix, rules_mask
from lucerna.operators.sampling import clamped_budget, diverse_rows, positive_count, select_sample, strategy_for
from lucerna.operators.weights import balanced_weights, beta_selectivity, objective_penalty, subjective_penalty, weighted_loss


def test_ladders():
    assert ladder(10, (0.6, 0.8, 1.0)) == [6, 2, 2] and ladder(3, (0.1, 0.2, 1.0)) == [1, 1, 1]
    with pytest.raises(ValueError):
        ladder(1, (0.5, 0.8, 1.0))


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 1000), st.lists(st.integers(1, 99), min_size=1, max_size=4, unique=True))
def test_ladder_parts_are_disjoint(n, steps):
    sizes = ladder(n, tuple(s / 100 for s in sorted(steps)))
    assert all(s >= 1 for s in sizes) and sum(sizes) <= n


def test_batches_partition_the_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = with_batches(df, (0.5, 0.9), 42, "k")
    assert {r["batch_id"]: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {0: 500, 1: 400}
    assert sorted(r["_rank"] for r in ranked(df, 1, "k", slices=16).collect()) == list(range(1, 1001))
    first = {r.k for r in sample(df, 10, 7, "k").collect()}
    assert first == {r.k for r in sample(df.repartition(7), 10, 7, "k").collect()} and len(first) == 10


@pytest.mark.parametrize("b,p,n,want", [(20, 3, 100, 3), (20, 100, 4, 16), (20, 0, 50, 0), (20, 50, 0, 20), (1, 5, 5, 1)])
def test_positive_allotment(b, p, n, want):
    assert positive_count(b, p, n) == want


def test_formulas():
    assert beta_selectivity((20, 10, 8), (80, 10, 1)) == pytest.approx(0.2833333333)
    assert balanced_weights(np.array([1, 0, 0, 0])).tolist() == pytest.approx([1 / 2, 1 / 6, 1 / 6, 1 / 6])
    assert weighted_loss([1, 0, 1, 0], [0, 1, 1, 0], 0.2) == pytest.approx(1.25)
    assert structural_probability(1, 3) == pytest.approx(0.749999875, abs=1e-9)
    assert objective_penalty(100, 0.2, 5, 2, 1, 0.2) == pytest.approx(3.4967399674)
    assert subjective_penalty(20, 0.25, 1, 0.2) == pytest.approx(0.7197788868)
    assert [most_errors(86, 6, x, 0.2) for x in range(3)] == [19, 35, 49] and [most_errors(86, 6, x, 0.1) for x in range(3)] == [26, 43, 56]
    assert f1_bound(0.05, 0.2) == pytest.approx(0.857142857) and f1_bound(0.2, 0.2) == 0
    u = updated_certificate(60, 20, 0.1, 3, 80, 5)
    assert (u.data_error, u.prediction_error, u.bound) == pytest.approx((0.25, 3 / 85, 0.3602941176))
    assert reoptimisation_threshold([60, 20], 0.2) == pytest.approx(0.3885215114)
    assert reoptimisation_threshold([60], 0.2) == reoptimisation_threshold([60, 0], 0.2) == math.inf
    assert best_candidate([0.3, 0.1, 0.1]) == 2 and predicate_budgets(3, 10) == [4, 3, 3] and clamped_budget(20, 7) == 7
    assert strategy_for(True, True) == "hybrid" and strategy_for(False, True) == "adaptive" and strategy_for(False, False) == "random"
    assert choose_depth([0.5, 0.46, 0.45], 20) == 0
    assert choose_depth([0.55, 0.46, 0.45], 20) == 1


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.data())
def test_most_errors_is_the_largest(population, data):
    drawn = data.draw(st.integers(0, population))
    seen = data.draw(st.integers(0, drawn))
    got = most_errors(population, drawn, seen, 0.1)
    assert got == max((k for k in range(population + 1) if hypergeometric_cdf(seen, population, k, drawn) > 0.1), default=0)
    assert 0 <= certificate(population, 0, drawn, 0, drawn, seen, 0.2, 1).bound <= 1


def test_quality(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "k int")
    q = quality(df.filter("k < 3"), df.filter("k > 1"), ["k"], 4)
    assert (q.tp, q.fp, q.fn, q.precision, q.recall, q.f1, q.err) == (1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    none = quality(df.limit(0), df.limit(0), ["k"], 0)
    assert (none.precision, none.recall, none.f1) == (1.0, 1.0, 1.0) and Quality(0, 0, 0, 5).err == 0
    assert {r.k for r in symmetric_difference(df, df.filter("k = 1").union(spark.createDataFrame([(9,)], "k int"))).collect()} == {2, 3, 9}
    rows = spark.createDataFrame([(1, "selected", True, 0), (2, "candidate", True, 1), (3, "candidate", False, 1), (4, "discarded", True, 1)], "k int, bucket string, label boolean, predicted int")
    got = bucket_quality(rows, ["k"])
    assert (got.tp, got.fp, got.fn, got.omega) == (2, 1, 1, 4)


def test_buckets_conserve_rows(spark):
    df = spark.createDataFrame([(i, i % 3, "t" * i) for i in range(20)], "k int, g int, t string").withColumn("batch_id", F.col("k") % 2)
    rows = B.with_truth(B.initialise(df, SemCQ(("k",), (Predicate("t", "!=", ""),)), "q"), df.filter("g = 1").unionAll(df.filter("g = 1")), ["k"])
    assert rows.count() == 19
    rows = B.refine(rows, [[Predicate("g", "==", 1)], [Predicate("k", ">", 15)]])
    human = spark.createDataFrame([(4, True), (16, True), (17, False)], "k int, human boolean")
    rows = B.annotate(rows, human, "k")
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 19 and sizes["selected"] == 2 and rows.filter("bucket = 'selected' and not annotated").count() == 0
    assert B.introduced_misses(rows) == 0 and B.stream_statistics(rows).count() == 3


def test_confidence_selection(spark):
    df = spark.createDataFrame([(i, i / 100) for i in range(100)], "k int, confidence double")
    got = {r.k: r.pseudo_label for r in select_empirical(df, "k", 0.3).collect()}
    assert got == {i: 1 for i in range(94, 100)} | {i: 0 for i in range(14)}
    assert select_empirical(df.limit(4), "k", 0.5).count() == 0  # a fifth of two rounds to none
    assert {r.pseudo_label for r in select_balanced(df, "k", 0.3).collect()} == {0, 1}
    at = df.limit(1).select(class_distance([F.lit(0.0), F.lit(0.0)], [[3.0, 4.0], [6.0, 8.0], [1.0, 0.0]], 2).alias("d")).first().d
    assert at == pytest.approx(3.0) and df.limit(1).select(class_distance([F.lit(0.0)], [], 2)).first()[0] == math.inf


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 10 == 0, f"word{i % 7} other{i % 3} text") for i in range(200)], "k int, guess boolean, text string")
    chosen = select_sample(df, "k", 20, "hybrid", 42, "guess", "text")
    assert len(chosen.ids) == len(set(chosen.ids)) == 20 and chosen.population == {"positive": 20, "negative": 180}
    assert sum(a for _, _, a in chosen.rows) == 4 and {s for _, s, _ in chosen.rows} == {"positive", "negative"}
    assert select_sample(df, "k", 20, "adaptive", 42, "guess").mode == "random"
    assert len(select_sample(df, "k", 20, "random", 42).ids) == 20 and len(select_sample(df.limit(5), "k", 20, "random", 1).ids) == 5
    assert len(diverse_rows(df, "k", "text", 2)) == 2
    assert chosen.frame(spark, "k", "int").count() == 20
    a, b = split_annotations(df.limit(10), "k", 42)
    assert a.count() == 7 and b.count() == 3


def test_forest_and_rules(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 10, 400), rng.random(400), rng.integers(0, 2, 400)], axis=1).astype(float)
    y = ((x[:, 0] > 5) & (x[:, 2] == 1)).astype(int)
    forest = train(x[:60], y[:60], ["a", "b", "c"], ForestConfig(50, 3, 2))
    assert (forest.predict(x) == y).mean() > 0.93 and forest.importances[1] < 0.3 and forest.importances.sum() == pytest.approx(1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=y))
    got = df.select("a", "b", "c", forest.column().alias("p")).toPandas()
    assert got["p"].to_numpy() == pytest.approx(forest.probability(got[["a", "b", "c"]].to_numpy()))
    rules = extract_rules(df, ["a", "b", "c"], "label", 5)
    assert (rules_mask(rules, x, ["a", "b", "c"]) == (y == 1)).mean() > 0.98 and len(rules) <= 5 and arity(rules) >= 2
    assert extract_rules(df.withColumn("label", F.lit(1)), ["a"], "label", 5) == [[]] and extract_rules(df.withColumn("label", F.lit(0)), ["a"], "label", 5) == []
    assert extract_rules(df, [], "label", 5) == [] and extract_rules(df, ["a"], "label", 0) == []
    many = extract_rules(df.withColumn("label", (F.col("a") % 2).cast("int")), ["a"], "label", 2, (x, (x[:, 0] % 2).astype(int), np.ones(400)))
    assert len(many) <= 2
    assert len(grow_leaves(x, y, np.ones(400), 4)) <= 4 and leave_one_out(x[:6], y[:6], ["a", "b", "c"], ForestConfig(5, 1), 2).shape == (2, 3)
    assert subjective_error(x[:1], y[:1], ["a"], 1, 0.2) == (0.0, 0.0)
    assert train(x[:5], np.ones(5), ["a", "b", "c"]).predict(x).all()


def test_features(spark, tmp_path):
    p = SemPredicate("t", "Text", "good", "Is it good?")
    own = semantic_feature(p)
    one, two = (FeatureSpec("t", "Text", n, f"{n}?", "int") for n in ("n_one", "n_two"))
    specs = with_mandatory(SemCQ(("k",), (), (p, p)), [one, two, own, one])
    assert specs == [own, one, two]
    assert rank_features(specs, {"n_two": 0.9, "n_one": 0.1}, 2) == [own, two]
    with pytest.raises(ValueError):
        rank_features(specs, {}, 0)
    assert accepted([one, FeatureSpec("u", "Text", "x", "x?", "int"), FeatureSpec("t", "Text", "bad", "b?", "undefined"), two], p, ["t"], set(), 3) == [one, two]
    assert accepted([one, two], p, ["t", "n_one"], set(), 2) == [two]
    assert [c.kind for c in candidates(["m", "x"], least_prefix(["m", "x"], {"m"}), ["b"])] == ["prefix", "prefix", "external_forest"]
    with pytest.raises(ValueError):
        active_columns(["a"], ["a"], ["b"])
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good"), (4, None)], "k int, t string")
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        name = "counting"

        def extract(self, rows, asked):
            def run(batches):
                for b in batches:
                    calls.add(len(b))
                    yield b.assign(**{asked[0].target: [len(x) if isinstance(x, str) else 0 for x in b["t"]]})

            return rows.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {asked[0].target} long")

    cache = FeatureCache(str(tmp_path / "features"))
    for part in (df.limit(2), df, df):
        out = cache.materialise(part, one, Counting())
        assert {r.k: r.n_one for r in out.collect()} == {k: n for k, n in ((1, 4), (2, 3), (3, 4), (4, 0)) if k <= part.count()}
    assert calls.value == 3  # each different value once
    assert table_fingerprint(df, ["k", "t"]) == table_fingerprint(df.repartition(3), ["k", "t"]) != table_fingerprint(df.limit(3), ["k", "t"])
    assert sync_columns(out, [two], [one])[0].columns == ["k", "t"]


def test_builders(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "x", 0), (2, None, 5)], "k int, v string, at int")
    assert {r.k: r.v for r in concat_distinct(a, ["k"], ["v"], "at").collect()} == {1: "x,y"}
    b = left_chain(a.select("k", "v"), (a.select("k", F.col("v")).filter("k = 2"), "k", "_b"))
    assert b.columns == ["k", "v", "v_b"] and b.count() == 4
