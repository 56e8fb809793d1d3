import numpy as np

import corpus_pipeline

from .test_simhash import similarity, slow_fingerprint


def slow_kept(rows):
    """doc_ids that stay of (doc_id, text), and how many similar pairs are further than six bits apart."""
    rows = sorted(rows)
    prints = [slow_fingerprint(t) for _, t in rows]
    up, far = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            bits, alike = (prints[i] ^ prints[j]).bit_count(), similarity(rows[i][1], rows[j][1]) >= 0.8
            far += alike and bits > 6
            if (bits <= 3 or alike) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    return {rows[x][0] for x in up}, far


def test_near_dedup_links_every_copy_of_similarity(spark, sf_dir):
    """All pairs of a five-word similarity of 0.8 or more link, whatever the distance of their fingerprints."""
    rng, texts = np.random.default_rng(17), []
    for base in range(40):
        words = [f"w{i}" for i in rng.integers(0, 3000, 200)]
        for k in range(4):
            some = list(words)
            for i in rng.choice(200, 1 + k % 3, replace=False):
                some[i] = f"Z{base}x{k}"
            texts.append(" ".join(some))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want, far = slow_kept(enumerate(texts))
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, sf_dir).collect()}
    assert far > 5 and left == want


def test_near_dedup_of_the_corpus(spark, sf_dir):
    docs = corpus_pipeline.exact(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, sf_dir).collect()} == slow_kept(rows)[0]
