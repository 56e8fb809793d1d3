import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.llm.components import components
from lucerna.llm.registry import QUERIES
from lucerna.llm.simhash import allot_thresholds, fingerprint, fingerprint_groups, links, near_dedup, plan

from .helpers import awkward, empty


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def similarity(a, b, n=5):
    """Jaccard similarity over different five-word shingles."""
    cut = lambda t: (lambda w: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})((t or "").encode().lower().split())
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def slow_groups(rows, further=lambda i, j: False):
    """doc_id -> component, over (doc_id, fingerprint); ``further`` decides on pairs of four to six bits."""
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and ((a ^ b).bit_count() <= 3 or (a ^ b).bit_count() <= 6 and further(i, j)):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf_dir).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_groups(list(prints.items()))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBZ é\t\n\x1c ", max_size=60))
def test_fingerprint_of_any_text(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_links_lose_none_in_a_dense_cluster(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64)
    dense = [int(np.int64(b) ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.integers(0, 64, rng.integers(0, 4))))) for b in base for _ in range(40)]
    prints = sorted({*map(int, base), *dense})
    found = [(r.a, r.b) for r in links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3).collect()]
    got = set(found)
    assert len(got) == len(found)
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_further_links_are_borne_out_by_similarity(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    texts = []
    for k in range(60):
        words = list(base)
        for i in rng.integers(0, 400, k // 2):
            words[i] = f"Z{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups([(i, slow_fingerprint(t)) for i, t in enumerate(texts)], lambda i, j: similarity(texts[i], texts[j]) >= 0.8)
    near = slow_groups([(i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in near_dedup(docs, further=6).collect()) == sorted(i for i, g in want.items() if i == g)
    assert len(set(want.values())) < len(set(near.values()))


def test_thresholds_keep_the_pigeonhole_sum():
    assert allot_thresholds([[0, 1, 9, 99, 99], [0, 5, 6, 9, 99]], 3) == (10, [0, 2])
    for parts in (2, 3, 4):
        chosen = plan(np.arange(500) * 7919**3, 10**6, 3, (parts,))
        assert sum(t + 1 for _, t in chosen) == 4


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, i) for i in range(101, 160)] + [(-5, 159)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: -5 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    got = fingerprint_groups(awkward(spark)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[3].component_id == by[4].component_id == by[5].component_id == 3 and by[3].fingerprint == "0" * 16
    assert by[2].component_id == by[None].component_id == 1 and by[9].component_id == 8
    assert fingerprint_groups(empty(spark)).count() == 0
    kept = near_dedup(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 6, 7, 8]
    assert near_dedup(empty(spark)).count() == 0 and kept.filter(F.col("doc_id") == 6).count() == 1
