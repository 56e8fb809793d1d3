import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.llm.packing import boundaries, pack, packed
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty


def padding(counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in counts)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    counts = list(histogram.items())
    ends = boundaries(counts, buckets)
    top = max(histogram)
    every = [[*some, top] for k in range(min(buckets, len(histogram))) for some in itertools.combinations(sorted(set(histogram) - {top}), k)]
    assert len(ends) <= buckets and ends[-1] == top
    assert padding(counts, ends) == min(padding(counts, e) for e in every)


def test_lengths_of_long_texts_are_exact(spark):
    """No more different lengths than buckets: nothing is padded, however long the texts are."""
    rows = [(i, 1500 + 2055 * (i % 10) - (i % 10 == 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, n long")
    out = pack(docs, F.col("n"), buckets=16).collect()
    assert len(out) == 400 and sum(r.padding for r in out) == 0
    few = pack(docs, F.col("n"), buckets=4).collect()
    counts = [(n, 40) for n in sorted({n for _, n in rows})]
    best = min(padding(counts, [*some, counts[-1][0]]) for some in itertools.combinations([n for n, _ in counts[:-1]], 3))
    assert sum(r.padding for r in few) == best


def test_query_packs_every_document(spark, sf_dir):
    rows = QUERIES["op5_packing"](spark, sf_dir).collect()
    docs = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == docs and len(rows) == len(docs)
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for some in batches.values():
        assert sorted(r.place for r in some) == list(range(len(some)))
        assert len(some) == 1 or len(some) * some[0].bucket_len <= 16_384
    counts = {}
    for n in docs.values():
        counts[n] = counts.get(n, 0) + 1
    assert {r.bucket_len for r in rows} <= set(counts)
    assert sum(r.padding for r in rows) == padding(list(counts.items()), boundaries(list(counts.items()), 16))


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = pack(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 11
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 11), (1, 11), (2, 11), (2, 11), (3, 0), (4, 0), (5, 0), (6, 30_000), (7, 6), (8, 1), (9, 1)]
    assert all(r.padding == 0 for r in rows) and {r.bucket_len for r in rows if r.n_tokens == 0} == {0}
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == 11
    assert packed(docs).filter("doc_id = 6 and bucket_len >= 30000").count() == 1
    assert packed(empty(spark)).count() == 0
