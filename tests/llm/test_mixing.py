import pytest
from pyspark.sql import functions as F

from lucerna.llm.common import materialise
from lucerna.llm.mixing import mix, mix_documents, sized_rows, taken_words
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty


def slow_targets(sizes):
    """source -> target, resharing until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len((d.text or "").encode().split())
    target = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    source = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s], rel=1e-9) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_query_meets_every_target_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = QUERIES["op7_mixing"](spark, sf_dir).repartition(3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_schedule_gives_each_slot_once_and_spreads_sources(spark, sf_dir):
    rows = materialise(sized_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("_m_row", F.monotonically_increasing_id()), "t")
    slots = mix(rows, block=64).filter("slot is not null").groupBy("slot").agg(F.countDistinct("source").alias("n"), F.sum(F.col("high") - F.col("low")).alias("words"))
    assert slots.filter("n > 1 or words > 64").count() == 0
    total = rows.agg(F.sum("_m_size")).first()[0]
    assert abs(slots.agg(F.sum("words")).first()[0] - 1.5 * total) <= 20


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = taken_words(docs).collect()
    assert len(rows) == 11
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    assert {(r.source_size, round(r.target, 6)) for r in rows} == {(n, round(slow_targets(sizes)[s], 6)) for s, n in sizes.items()}
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert taken_words(empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 30_000, "b": 10_000, "c": 20_000}, {"a": 900, "b": 4000, "c": 800, "d": 900}, {"a": 3, "b": 1, "c": 2, "d": 3, "e": 1, None: 2}, {"a": 500, "b": 0, "c": 7}, {"a": 10, "b": 9000}])
def test_targets_of_tied_sources(spark, sizes):
    """Sources of the same size for their weight, equal sources, and sources that are all but one capped."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    rows = taken_words(docs).collect()
    check(rows, docs.collect())
    assert sum(r.target for r in rows) == pytest.approx(1.5 * sum(sizes.values()))


def test_targets_when_every_source_is_capped(spark):
    rows = materialise(spark.createDataFrame([(0, 0, "a", 7), (1, 1, "b", 5)], "_m_row long, doc_id long, source string, _m_size long"), "t")
    from lucerna.llm.mixing import source_targets

    assert sorted((r.source, r.target) for r in source_targets(rows, share=2.5).collect()) == [("a", 14.0), ("b", 10.0)]


def test_mixed_documents(spark):
    docs = awkward(spark)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    whole = {tuple(r) for r in docs.collect()}
    rows = mixed.collect()
    assert {tuple(r) for r in rows} <= whole
    expected = sorted((r.doc_id or 0) for r in taken_words(docs).collect() for turn in (0, 1) if r.size and 2 * min(r.size, r.taken - turn * r.size) >= r.size)
    assert sorted((r.doc_id or 0) for r in rows) == expected
    assert mix_documents(empty(spark)).count() == 0
