import math
from collections import Counter

import pytest

import lucerna.llm.lm_score as lm_score
from lucerna.llm.lm_score import scored, word_hashes
from lucerna.llm.registry import QUERIES

from .helpers import awkward, empty


def slow(docs, backoff=0.4, least=2):
    """(n_words, score, n_backoff) of each text, by dictionaries."""
    words = [(t or "").encode().split() for t in docs]
    uni, pair = Counter(w for d in words for w in d), Counter((a, b) for d in words for a, b in zip(d, d[1:]))
    n_all = sum(uni.values())
    for d in words:
        score, backed = 0.0, 0
        for i, w in enumerate(d):
            if i and pair[d[i - 1], w] >= least:
                score += math.log10(pair[d[i - 1], w] / uni[d[i - 1]])
            else:
                score += math.log10((backoff if i else 1) * uni[w] / n_all)
                backed += i > 0
        yield len(d), score, backed


@pytest.mark.parametrize("least,block_bytes,part_bytes", [(2, 24_000_000, 64_000_000), (2, 40_000, 50_000), (1, 300_000, 200_000)])
def test_matches_brute_force(spark, sf_dir, least, block_bytes, part_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in scored(docs, least=least, block_bytes=block_bytes, part_bytes=part_bytes).collect()}
    assert set(got) == set(rows)
    for i, (n, score, backed) in zip(rows, slow(rows.values(), least=least)):
        assert (got[i].n_words, got[i].n_backoff) == (n, backed)
        assert got[i].score == pytest.approx(score, rel=1e-9) and got[i].mean_score == pytest.approx(score / n, rel=1e-9)


@pytest.mark.parametrize("fan", [2, 5])
def test_many_tables_are_asked_in_rounds(spark, sf_dir, monkeypatch, fan):
    """More tables than a block asks at once: the same counts, through two or more rounds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (r.score, r.n_backoff) for r in scored(docs, block_bytes=60_000, part_bytes=10**9).collect()}
    monkeypatch.setattr(lm_score, "FAN", fan)
    got = {r.doc_id: (r.score, r.n_backoff) for r in scored(docs, block_bytes=60_000, part_bytes=30_000).collect()}
    assert set(got) == set(want) and all(got[i][1] == n and got[i][0] == pytest.approx(x, rel=1e-9) for i, (x, n) in want.items())


def test_query_scores_every_document(spark, sf_dir):
    assert QUERIES["op1_lm_score"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_word_hashes():
    a = word_hashes("one two  one\n\ttwo é one")
    assert len(a) == 6 and a[0] == a[2] == a[5] and a[1] == a[3] and len(set(a.tolist())) == 3
    assert len(word_hashes("")) == len(word_hashes(None)) == len(word_hashes(" \n")) == 0
    long_text = "alpha beta " * 200_000
    h = word_hashes(long_text)
    assert len(h) == 400_000 and set(h.tolist()) == set(word_hashes("alpha beta").tolist())


def test_words_longer_than_a_chunk(monkeypatch):
    """A long word is one word, whatever stands around it, and differs from its beginning."""
    monkeypatch.setattr(lm_score, "_CHUNK", 64)
    texts = ["a" * 500, "b " + "a" * 500 + " c", " \n" * 40 + "a" * 500 + "\t" * 100 + "x y", "a" * 64, "a" * 63, "a" * 65 + " " + "a" * 64]
    got = [word_hashes(t) for t in texts]
    assert [len(h) for h in got] == [len(t.split()) for t in texts]
    assert got[0][0] == got[1][1] == got[2][0] and len({int(got[i][0]) for i in (0, 3, 4, 5)}) == 4 and got[5][1] == got[3][0]
    monkeypatch.undo()
    assert all((word_hashes(t) == h).all() for t, h in zip(texts, got))


def test_awkward_rows(spark):
    rows = scored(awkward(spark)).collect()
    assert len(rows) == 11 and sum(r.score is None for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    assert scored(empty(spark)).count() == 0
