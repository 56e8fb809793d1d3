import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lucerna.llm.registry import QUERIES
from lucerna.llm.toxicity import BUCKETS, CHUNK, CLEAN_SHARE, KEEP, SEEN, Model, drop_toxic, features, fit, present, score, scored

from .helpers import awkward, empty


def slow_grams(text):
    raw, found = text.lower().encode(), set()
    for n in (4, 5, 6):
        for i in range(len(raw) - n + 1):
            found.add(int.from_bytes(raw[i : i + n], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 44)
    return found


def test_features_are_all_ngrams():
    text = "The QUICK brown fox, naïve \U0001f600 " * 3
    assert set(present(text).tolist()) == slow_grams(text)
    assert present("").size == present(None).size == present("abc").size == 0
    long_text = "".join(chr(97 + i * i % 23) for i in range(CHUNK + 99))
    assert sum(len(x) for x in features(long_text)) == sum(len(long_text) - n + 1 for n in (4, 5, 6))


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    rows = QUERIES["op4_toxicity"](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert rows.count() == docs.count()
    got = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    right = [r for r in held if r.toxic]
    found = [r for r in held if r.predicted]
    both = [r for r in right if r.predicted]
    assert len(both) >= 0.88 * len(right) and len(both) >= 0.85 * len(found)


def slow_model(texts, y, rounds=200, penalty=1e-4):
    """(intercept, weight of each feature) by dictionaries and plain loops: counts, ratios, choice, gradient descent."""
    grams = [slow_grams(t) for t in texts]
    counts = {c: {} for c in (0, 1)}
    for g, label in zip(grams, y):
        for x in g:
            counts[label][x] = counts[label].get(x, 0) + 1
    n = {c: sum(1 for label in y if label == c) for c in (0, 1)}
    mass = {c: BUCKETS + sum(counts[c].values()) for c in (0, 1)}
    ratio, apart = {}, {}
    for x in set(counts[0]) | set(counts[1]):
        q, p = (counts[c].get(x, 0) for c in (0, 1))
        ratio[x] = math.log((1 + p) / mass[1]) - math.log((1 + q) / mass[0])
        share = (p + q) / len(y)
        apart[x] = 0 if p + q < SEEN else abs(p / n[1] - q / n[0]) / math.sqrt(max(share * (1 - share), 1e-12)) * (CLEAN_SHARE if ratio[x] < 0 else 1)
    chosen = sorted(sorted((x for x in apart if apart[x] > 0), key=lambda x: (-apart[x], x))[:KEEP])
    rows = [[x for x in chosen if x in g] for g in grams]
    norm = max(sum(ratio[x] ** 2 for x in r) for r in rows) + 1
    share = (n[1] + 1) / (len(y) + 2)
    bias, w = math.log(share / (1 - share)), dict.fromkeys(chosen, 0.0)
    at_b, at_w, t = bias, dict(w), 1.0
    for _ in range(rounds):
        miss = [(1 / (1 + math.exp(-(at_b + sum(ratio[x] * at_w[x] for x in r)))) - label) / len(y) for r, label in zip(rows, y)]
        grad = {x: penalty * at_w[x] for x in chosen}
        for r, m in zip(rows, miss):
            for x in r:
                grad[x] += ratio[x] * m
        step, t_next = len(y) / norm, (1 + math.sqrt(1 + 4 * t * t)) / 2
        new_b, new_w = at_b - step * sum(miss), {x: at_w[x] - step * grad[x] for x in chosen}
        k = (t - 1) / t_next
        at_b, at_w = new_b + k * (new_b - bias), {x: new_w[x] + k * (new_w[x] - w[x]) for x in chosen}
        bias, w, t = new_b, new_w, t_next
    return bias, {x: w[x] * ratio[x] for x in chosen}


def test_fit_and_scores_against_plain_loops(spark):
    """Counts, log-count ratios, choice of features, training and scores, all by a slow version."""
    rng = random.Random(4)
    bad, fine = ["awful scum", "you clown", "vile loser"], ["good day", "nice tree", "some rain", "a cup of tea"]
    texts = [" ".join(rng.choice(fine) for _ in range(4)) + (" " + rng.choice(bad) if i % 3 == 0 else "") for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    used = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    bias, weights = slow_model([texts[i] for i in used], [int(i % 3 == 0) for i in used])
    got = {r.doc_id: r.score for r in scored(docs, labels).collect()}
    for i, t in enumerate(texts):
        x = bias + sum(weights.get(g, 0.0) for g in slow_grams(t))
        assert abs(got[i] - 1 / (1 + math.exp(-x))) < 1e-4
    model = fit(docs, labels)
    assert abs(model.bias - bias) < 1e-4 and np.count_nonzero(model.weights) == sum(v != 0 for v in weights.values())


def test_held_out_labels_change_nothing(spark, sf_dir):
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, labels), fit(docs, turned)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    rows = scored(docs, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in scored(docs, none).collect()} == {0.5}
    assert scored(empty(spark), labels).count() == 0
    assert drop_toxic(docs, labels).columns == docs.columns
    kept = score(docs.withColumn("score", F.lit("x")).drop("score"), Model(-9.0, np.zeros(BUCKETS, np.float32)))
    assert kept.filter("predicted = 0").count() == 11
