"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the byte n-grams of the lower-cased text, hashed to ``buckets``; a feature is present or absent. On at
most ``max_rows`` labelled rows (chosen by a hash of their id: the documented bound of the fit) the ratios
r = log((1 + p) / |p|) - log((1 + q) / |q|) of its counts in both classes scale each feature, and a logistic
regression with an L2 penalty is trained over the ``keep`` features whose shares differ most (a parameter of the model,
whatever the size of the input: with many more, a few hundred toxic examples are learned by heart, and fewer of those
held out are found). Every whole text is scored with one table of weights.

Defined cases: null and empty texts have no features and get the score of the intercept; a null doc_id is never
labelled nor held out; of several labels of a document the largest counts; null labels are left out; without
labels of both classes the score is the smoothed share of toxic labels; an empty table gives an empty result.
Extra columns are kept by ``score``; names starting with ``_t_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Orders of the n-grams, in bytes.
ORDERS = (4, 5, 6)
#: Bits of a feature's hash.
HASH_BITS = 20
BUCKETS = 1 << HASH_BITS
#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 20_000
#: Features of a model, at most, and labelled rows that a feature must be in.
KEEP = 1024
SEEN = 3
#: Weight of features that speak for the clean class when features are chosen: the toxic class is the rare one.
CLEAN_SHARE = 0.3
THRESHOLD = 0.3
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: Odd multiplier of the hash.
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, with repeats, in pieces of bounded size."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), CHUNK):
        piece = raw[at : at + CHUNK + ORDERS[-1] - 1].astype(np.uint64)
        gram = np.zeros(len(piece), np.uint64)
        for k in range(ORDERS[-1]):
            gram = gram[: len(piece) - k] | piece[k:] << np.uint64(8 * k) if len(piece) > k else gram[:0]
            if k + 1 in ORDERS:
                own = gram[:CHUNK]
                yield (own * MIX >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Features of a text, each once; of those where ``wanted`` isn't zero."""
    found = [x if wanted is None else x[wanted[x] != 0] for x in features(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = self.bias + float(self.weights[present(text, self.weights)].sum(dtype=np.float64))
        return 1 / (1 + float(np.exp(-np.clip(x, -40, 40))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, y: the labelled rows to learn from, at most ``max_rows``."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("_t_id"), "y")
    # at most max_rows pairs of numbers are sent to the executors
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_t_id"))
    one = joined.groupBy("_t_id", "y").agg(F.min("text").alias("text"))
    return materialise(one.select("text", "y").repartition(max(8, -(-max_rows // 20_000))), "labelled")


def _counts(batches):
    totals, n = np.zeros((2, BUCKETS), np.uint16), np.zeros(2, np.int64)  # a part has 2,500 rows or so
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            totals[int(y > 0), present(text)] += 1
            n[int(y > 0)] += 1
    yield pd.DataFrame({"q": [totals[0].tobytes()], "p": [totals[1].tobytes()], "n_q": n[:1], "n_p": n[1:]})


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> tuple[float, np.ndarray]:
    """Accelerated gradient descent over sparse rows of features scaled by ``scale``."""
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    value = scale[which]
    n, d = len(y), len(scale)
    share = (y.sum() + 1) / (n + 2)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(d)
    norm = np.bincount(where, value**2, n).max(initial=1.0) + 1
    step, seen = 4 / norm, (bias, weights)
    t = 1.0
    for _ in range(rounds):
        b, w = seen
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(where, value * w[which], n), -40, 40)))
        miss = (p - y) / n
        new_b, new_w = b - step * n * miss.sum() / 4, w - step * n * (np.bincount(which, value * miss[where], d) / 4 + penalty * w / 4)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        seen = (new_b + (t - 1) / t_next * (new_b - bias), new_w + (t - 1) / t_next * (new_w - weights))
        bias, weights, t = new_b, new_w, t_next
    return bias, weights


def selected(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios of all features, and the chosen ones, rising, from their counts in toxic (p) and clean (q) rows."""
    ratio = np.log((1 + p) / (1 + p).sum()) - np.log((1 + q) / (1 + q).sum())
    both = (p + q) / (n_p + n_q)
    apart = np.abs(p / n_p - q / n_q) / np.sqrt(np.maximum(both * (1 - both), 1e-12))
    apart[p + q < SEEN] = 0
    apart[ratio < 0] *= CLEAN_SHARE
    chosen = np.sort(np.argsort(-apart, kind="stable")[:keep])
    return ratio, chosen[apart[chosen] > 0]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: int = KEEP) -> Model:
    rows = training_rows(docs, labels, max_rows)
    parts = rows.mapInPandas(_counts, "q binary, p binary, n_q long, n_p long").collect()
    q, p = (sum((np.frombuffer(r[c], np.uint16).astype(np.float64) for r in parts), np.zeros(BUCKETS)) for c in ("q", "p"))
    n_q, n_p = sum(r["n_q"] for r in parts), sum(r["n_p"] for r in parts)
    table = np.zeros(BUCKETS, np.float32)
    if not n_q or not n_p:
        share = (n_p + 1) / (n_q + n_p + 2)
        return Model(float(np.log(share / (1 - share))), table)
    ratio, chosen = selected(p, q, n_p, n_q, keep)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    wanted = (place >= 0).astype(np.int8)

    def rows_of(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [place[present(t, wanted)].astype(np.uint16).tobytes() for t in batch["text"]], "y": (batch["y"] > 0).astype(int)})

    got = rows.mapInPandas(rows_of, "x binary, y int").collect()
    sparse = [np.frombuffer(r["x"], np.uint16).astype(np.int64) for r in got]
    bias, weights = _logistic(sparse, np.array([r["y"] for r in got], float), ratio[chosen])
    table[chosen] = weights * ratio[chosen]
    return Model(bias, table)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", each("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted clean."""
    judged = score(docs.withColumnsRenamed({c: f"_t_{c}" for c in ("score", "predicted") if c in docs.columns}), fit(docs, labels), threshold)
    return judged.filter("predicted = 0").drop("score", "predicted").withColumnsRenamed({f"_t_{c}": c for c in ("score", "predicted")}).select(*docs.columns)
