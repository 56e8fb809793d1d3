from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.llm.quality_rules import RULES, Rule, apply_rules, compile_rules, measures, ratios
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty


def slow(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def read(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        n, _, _, _, repeated = want = slow(texts[r.doc_id])
        assert read(r) == want and r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_random_texts(spark):
    made = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a", "b", "c#", "é|", "\n", " ", "\x1c", "\t"]), max_size=60).map(" ".join))
    def collect(text):
        made.append(text)

    collect()
    rows = measures(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    assert [read(r) for r in sorted(rows, key=lambda r: r.doc_id)] == [slow(t) for t in made]


def test_rules_compile_to_one_projection_without_python(spark, sf_dir):
    plan = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    row = spark.range(1).select(F.lit(9).alias("n_words"), *[F.lit(1).alias(c) for c in ("word_chars", "n_symbols", "n_stop_words", "n_dup_lines", "n_lines", "n_repeat_words")])
    assert set(ratios()) >= {r.measure for r in RULES}
    assert row.select(compile_rules((Rule("words", least=9, most=9),))).first()[0] is True
    assert row.select(compile_rules((Rule("words", most=8),))).first()[0] is False
    assert row.select(compile_rules((Rule("words", most=8, from_words=10),))).first()[0] is True
    assert row.select(compile_rules(())).first()[0] is True


def test_a_filter_on_the_verdict_stays_linear(spark):
    text = " ".join(f"w{i % 4000}" for i in range(20_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    assert apply_rules(docs).filter("base_failed").count() == 3


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = apply_rules(docs)
    assert rows.columns[:7] == [*docs.columns[:5], "size", "label"] or "kept" in rows.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert read(got[3]) == read(got[4]) == read(got[5]) == (0, 0, 0, 0, 0) and got[3].base_failed and not got[3].kept
    assert read(got[6]) == slow(docs.filter("doc_id = 6").first().text)
    assert rows.count() == 11 and apply_rules(empty(spark)).count() == 0
