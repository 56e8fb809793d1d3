import numpy as np
import pytest

from lucerna.llm.lm_score import scored

from .test_lm_score import slow


def test_every_word_counts_as_itself(spark):
    """More different words than 65,535: rare ones have counts of their own, and made-up ones score worst."""
    rng = np.random.default_rng(3)
    texts = [" ".join([f"r{k}x{i}" for i in range(3000)] + [f"c{i}" for i in rng.integers(0, 400, 600)] + [f"r{(k + 1) % 30}x{i}" for i in range(200)]) for k in range(30)]
    texts.append(" ".join(f"madeup{i}" for i in range(200)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scored(docs, block_bytes=200_000, part_bytes=100_000).collect()}
    for i, (n, score, backed) in enumerate(slow(texts)):
        assert (got[i].n_words, got[i].n_backoff) == (n, backed) and got[i].score == pytest.approx(score, rel=1e-9)
    assert min(got.values(), key=lambda r: r.mean_score).doc_id == 30
