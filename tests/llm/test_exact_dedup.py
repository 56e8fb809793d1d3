import hashlib
import re

from pyspark.sql import functions as F

from lucerna.llm.exact_dedup import BROADCAST_WORDS, CELLS, _probe, exact_dedup, exact_groups
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty


def slow(rows):
    """(doc_id, keep_id, group_size, kept, sha) of rows with unique ids."""
    digest = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in rows}
    groups = {}
    for i, s in digest.items():
        groups.setdefault(s, []).append(i)
    return sorted((i, min(groups[s]), len(groups[s]), i == min(groups[s]), s) for i, s in digest.items())


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = QUERIES["op10_exact_dedup"](spark, sf_dir)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == slow(rows)
    assert sorted(r.doc_id for r in exact_dedup(docs).collect()) == [i for i, _, _, kept, _ in slow(rows) if kept]


def test_a_full_filter_gives_the_same_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tight = exact_groups(docs, cells_per_row=1)
    assert sorted(map(tuple, tight.collect())) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_a_partitioned_filter_gives_the_same_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    apart = exact_groups(docs, broadcast_words=0)
    assert sorted(map(tuple, apart.collect())) == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in exact_dedup(docs, broadcast_words=0).collect()) == sorted(r.doc_id for r in exact_dedup(docs).collect())


def test_few_rows_without_an_equal_are_flagged(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 100, F.lit(0)).otherwise(F.col("id"))).alias("text"))
    flagged = _probe(docs, "text", CELLS, BROADCAST_WORDS).filter("_dd_flag")
    assert flagged.filter("doc_id < 100").count() == 100 and flagged.count() < 2500


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op10_exact_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = exact_groups(docs).collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 7
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {1} and [r.doc_id for r in same if r.kept] == [1]
    void = [r for r in got if r.doc_id in (3, 4)]
    assert {r.keep_id for r in void} == {3} and [r.kept for r in sorted(void)] == [True, False]
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert exact_groups(empty(spark)).count() == exact_dedup(empty(spark)).count() == 0


def test_of_repeated_rows_one_stays(spark):
    rows = spark.createDataFrame([(5, "x y"), (5, "x  y"), (5, "x\ny"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = exact_groups(rows).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (0, True), (5, False), (5, False), (5, True)]
    assert exact_dedup(rows).count() == 2
