import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lucerna.llm.suffix_dedup as suffix_dedup
from lucerna.llm.anchors import units, unpacked_place
from lucerna.llm.registry import QUERIES
from lucerna.llm.suffix_array import common_prefixes, suffix_array
from lucerna.llm.suffix_dedup import deduplicated, repeated_windows

from .helpers import awkward, empty


def slow(texts, length=200):
    """(n_bytes, n_removed, n_spans, digest) of each text, from a count of all windows."""
    raws = [(t or "").encode() for t in texts]
    often = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if often[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        yield len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def check(spark, texts, length=200):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in deduplicated(docs, length).collect()}
    assert got == dict(enumerate(slow(texts, length)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_and_prefixes(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    for (a, b), h in zip(zip(order, order[1:]), common_prefixes(text, order)[1:]):
        assert text[a : a + h] == text[b : b + h] and (a + h == len(text) or b + h == len(text) or text[a + h] != text[b + h])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_units_cover_every_window_and_repeat_alike(seed):
    rng = random.Random(seed)
    words = [rng.randbytes(rng.randint(1, 9)) for _ in range(rng.choice([1, 5, 40]))]
    raw = b"".join(rng.choice(words) for _ in range(rng.randint(0, 400)))
    h, u, place = units(raw, 200)
    seen, alike = [], {}
    for a, b, p in zip(h.tolist(), u.tolist(), place.tolist()):
        first, anchor, more = unpacked_place(p)
        seen += range(first, first + more + 1)
        assert first + more <= first + anchor <= first + 152
        for i in range(more + 1):
            alike.setdefault(raw[first + i : first + i + 200], set()).add((a, anchor - i))
        assert alike.setdefault((a, b), raw[first : first + more + 200]) == raw[first : first + more + 200]
    assert seen == list(range(max(0, len(raw) - 199)))
    assert all(len(x) == 1 for k, x in alike.items() if isinstance(k, bytes))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_comparison_of_units(seed):
    rng = random.Random(seed)
    length, anchor = 20, b"ANCHOR"
    members = []
    for _ in range(rng.randint(2, 6)):
        left, right = (bytes(rng.choice(b"ab") for _ in range(14)) for _ in range(2))
        offset = rng.randint(0, 14)
        whole = left[14 - offset :] + anchor + right
        more = rng.randint(0, min(offset, len(whole) - length)) if len(whole) >= length else -1
        if more >= 0:
            members += [(whole[: more + length], offset, more)] * rng.choice([1, 1, 2])
    windows = Counter((m[1] - i, m[0][i : i + length]) for m in members for i in range(m[2] + 1))
    members.sort()
    for (raw, offset, more), runs in zip(members, next(repeated_windows([members], length)) if members else []):
        got = {i for a, b in runs for i in range(a, b + 1)}
        assert got == {i for i in range(more + 1) if windows[offset - i, raw[i : i + length]] > 1}


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:5] for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == dict(zip((r.doc_id for r in rows), slow([r.text for r in rows])))
    assert sum(x[1] for x in got.values()) > 0


def mutated(rng):
    base = "".join(rng.choice("abcdefgh ijé") for _ in range(3000))
    texts = [base, base[500:1200], "x" * 450, "x" * 199, "ab" * 160, base[:199], "", None]
    for _ in range(25):
        t = list(base[rng.randint(0, 900) : rng.randint(1500, 3000)])
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice("QRS")
        texts.append("".join(t))
    return [*texts, *("".join(rng.choice("mnop") for _ in range(rng.randint(0, 300))) + base[1000:1250] + "".join(rng.choice("mnop") for _ in range(90)) for _ in range(40))]


def test_edited_copies_shared_passages_and_runs(spark):
    check(spark, mutated(random.Random(8)))


@pytest.mark.parametrize("split", [2, 3, 7])
def test_large_classes_are_divided(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    check(spark, mutated(random.Random(9 + split)))


def test_a_class_of_many_units(spark):
    """One passage in 2,000 texts, between bytes of their own, some of which are shared by a few."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    some = ["".join(rng.choice("mnop") for _ in range(120)) for _ in range(40)]
    texts = [rng.choice(some)[rng.randint(0, 60) :] * (k % 3 > 0) + f"{k:07d}"[: rng.randint(0, 7)] + passage + rng.choice(some)[: rng.randint(0, 120)] + str(k) for k in range(2000)]
    check(spark, texts)


def test_many_copies_take_linear_time(spark):
    """Repeated rows, with equal and with null ids."""
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, text)] * 300 + [(None, text)] * 100 + [(2, text[:300] + "!")]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in got) == {(1, 20_000, 1): 300, (None, 20_000, 1): 100, (2, 300, 1): 1}


def test_a_partitioned_filter_gives_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 8)
    check(spark, mutated(random.Random(12)))


def test_awkward_rows(spark):
    rows = deduplicated(awkward(spark)).collect()
    assert len(rows) == 11 and {r.n_bytes for r in rows if r.doc_id in (3, 4)} == {0}
    assert deduplicated(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "y z" * 100), (1, "y z" * 100), (None, "q" * 201)], "doc_id long, text string")
    assert sorted((r.n_removed, r.n_spans) for r in deduplicated(twice).collect()) == [(201, 1), (300, 1), (300, 1)]
