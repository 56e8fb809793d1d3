"""Batches after the first: carry a query's rules over, measure how far they have drifted, and refresh them if needed.

``run_rounds`` goes through the batches of one table; ``Feed`` does the same inside Structured Streaming, a batch of the
stream at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import apply_rules
from ..operators import buckets as B
from ..operators.certify import f1_bound, reoptimisation_threshold, smoothed, updated_certificate
from ..operators.forest import ForestConfig, propagate, train
from ..operators.quality import bucket_quality


def _first_bound(state) -> float:
    return state.certificate.bound if state.certificate else 0.0


def carried_over(state, batch: int) -> dict[str, Any]:
    """A batch without candidates: the certificate stays and no error is added."""
    bound = state.rounds[-1]["bound"] if state.rounds else _first_bound(state)
    return {"batch": batch, "candidates": 0, "data_error": 0.0, "prediction_error": 0.0, "bound": bound, "f1_bound": f1_bound(bound, state.pi) if state.pi > 0 else 0.0, "smoothed": 0.5 * bound, "threshold": float("inf"), "refresh": False, "f1": 1.0}


def one_round(engine, state, batch: int) -> dict[str, Any]:
    """Grow the coreset by the batch's surest rows, fit again, and compare with the old labels.

    The new forest has the default depth, whatever the first one's. Sizes in the certificate are those of the previous
    and the current batch, not running totals.
    """
    sizes = {r["batch_id"]: r["count"] for r in state.rows.filter(F.col("bucket") == B.CANDIDATE).groupBy("batch_id").count().collect()}
    current, previous = sizes.get(batch, 0), sizes.get(batch - 1, 0)
    if not current:
        return carried_over(state, batch)
    engine.expand(state, batch)
    names = list(state.attempt.candidate.features)
    coreset = pd.concat([state.labelled, state.pseudo]) if len(state.pseudo) else state.labelled
    x = coreset[names].astype(float).fillna(0.0).to_numpy() if names else np.zeros((len(coreset), 0))
    forest = train(x, coreset["label"].to_numpy(int), names, ForestConfig(), seed=engine.config.random_seed) if len(coreset) and names else None
    old = state.rows.filter((F.col("bucket") == B.CANDIDATE) & (F.col("batch_id") < batch))
    both = propagate(propagate(old, state.attempt.forest, "old"), forest, "new")
    r = both.agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("new")).alias("changed")).first()
    selected = state.rows.filter(F.col("bucket") == B.SELECTED).count()
    before = state.rounds[-1]["bound"] if state.rounds else _first_bound(state)
    update = updated_certificate(previous, current, before, r["changed"], r["n"], selected)
    value = smoothed(update, before)
    limit = reoptimisation_threshold([sizes.get(b, 0) for b in range(batch + 1)], engine.config.delta)
    quality = bucket_quality(apply_rules(state.rows.filter(F.col("batch_id") == batch), state.rules), list(state.query.selected))
    return {
        "batch": batch, "candidates": current, "data_error": update.data_error, "prediction_error": update.prediction_error, "bound": update.bound,
        "f1_bound": f1_bound(update.bound, state.pi) if state.pi > 0 else 0.0, "smoothed": value, "threshold": limit, "refresh": value >= limit, "f1": quality.f1,
    }


def run_rounds(engine, state, refresh: bool = False) -> None:
    """All batches after the first. With ``refresh`` the rules are learned anew when a round asks for it; else the
    decision is only recorded."""
    for batch in range(1, len(engine.config.dynamic_setting)):
        state.rounds.append(one_round(engine, state, batch))
        if refresh and state.rounds[-1]["refresh"]:
            engine.rewrite(state)


@dataclass
class Feed:
    """A stream answered by rules: each batch is filtered, its features extracted, rules applied, the answer written.

    The answer of a batch goes to its own partition and is overwritten when the batch is retried, so a retry never
    doubles rows.
    """

    prepare: Callable[[DataFrame], DataFrame]
    rules: list
    path: str
    sizes: list[int] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        answered = apply_rules(self.prepare(batch), self.rules).filter("predicted = 1").drop("predicted")
        answered.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        self.sizes.append(batch.count())

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts for each key and event-time window; rows later than the watermark are dropped. An addition."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).count().select(F.col("window.start").alias("start"), key, "count")
