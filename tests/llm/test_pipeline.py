from collections import Counter

import corpus_pipeline
from lucerna.llm.common import materialise
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty
from .test_exact_dedup import slow as slow_exact
from .test_mixing import slow_targets
from .test_pipeline_copies import slow_kept


def words(text):
    return len((text or "").encode().split())


def test_each_stage_against_brute_force(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        seen.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    toxic = {r.doc_id for r in QUERIES["op4_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    clean, once, apart, mixed, packed = seen
    assert Counter(clean) == Counter(r for r in start if r.doc_id not in toxic) and toxic
    assert {r.doc_id for r in once} == {i for i, _, _, kept, _ in slow_exact([(r.doc_id, r.text) for r in clean]) if kept} and len(once) < len(clean)
    left, _ = slow_kept([(r.doc_id, r.text) for r in once])
    assert Counter(apart) == Counter(r for r in once if r.doc_id in left) and len(apart) < len(once)
    sizes, taken = Counter(), Counter()
    whole = {r.doc_id: r for r in apart}
    for r in apart:
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
        assert r == whole[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    longest = {s: max(words(r.text) for r in apart if r.source == s) for s in sizes}
    for s, target in slow_targets(sizes).items():  # one document of a source comes in or stays out as a whole
        assert abs(taken[s] - target) <= 0.5 + longest[s] / 2
    assert Counter((r.doc_id, r.text) for r in packed) == Counter((r.doc_id, r.text) for r in mixed)
    rows = Counter((r.bucket, r.batch) for r in packed)
    assert all(n == 1 or n * next(r.bucket_len for r in packed if (r.bucket, r.batch) == k) <= 16_384 for k, n in rows.items())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "text", "bucket", "batch", "padding"} <= set(out.columns)


def test_awkward_rows(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, docs, sf_dir), "stage")
            assert name == "packing" or out.columns == docs.columns
            docs = out
