"""Confidence of candidates: distances to labelled rows of each class, forest probabilities, and coreset selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-6
#: Share of each end that enters the coreset in the first round.
EMPIRICAL = 0.2


def class_distance(features: Sequence[Column], points: Sequence[Sequence[float]], k: int) -> Column:
    """Mean Euclidean distance to the ``k`` nearest of some labelled points; infinite without points.

    The points are a labelling budget's worth, so they are literals: a projection, without any join.
    """
    if not points:
        return F.lit(float("inf"))
    at = F.array(*[f.cast("double") for f in features])
    table = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in points])
    return nearest_mean(at, table, k)


def nearest_mean(at: Column, points: Column, k: int) -> Column:
    """Mean of the ``k`` least distances between an array of numbers and those in an array of arrays."""
    square = lambda a, b: (a - b) * (a - b)
    apart = lambda p: F.sqrt(F.aggregate(F.zip_with(at, p, square), F.lit(0.0), lambda s, x: s + x))
    nearest = F.slice(F.array_sort(F.transform(points, apart)), 1, k)
    return F.aggregate(nearest, F.lit(0.0), lambda s, x: s + x) / F.size(nearest)


def structural_confidence(positive: Column, negative: Column) -> Column:
    """Closeness to the positive class against both: inverse distances, smoothed."""
    near, far = 1 / (positive + EPS), 1 / (negative + EPS)
    return F.when(near + far > 0, near / (near + far)).otherwise(F.lit(0.5))


def combined_confidence(pi: float, predicted: Column | None, structural: Column | None) -> Column:
    """pi * prediction + (1 - pi) * structure; a part that is switched off adds nothing; without both: pi."""
    if predicted is None and structural is None:
        return F.lit(float(pi))
    out = F.lit(0.0)
    out = out + F.lit(float(pi)) * predicted if predicted is not None else out
    return out + F.lit(1 - float(pi)) * structural if structural is not None else out


def confidence_ranks(rows: DataFrame, row_id: str, confidence: str = "confidence") -> DataFrame:
    """``rows`` with _place: rank by falling confidence, ties by row id. Slices are ranked apart, so no task has to sort all
    rows; a forest gives few different values, so a slice may also be of one value and a range of row ids."""
    level = F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))) * 4096)
    sliced = rows.withColumn("_u", level).withColumn("_t", id_slice(rows, row_id))
    # a step of confidence that holds one value is cut by row ids; there are 4097 steps at most
    several = sliced.groupBy("_u").agg((F.min(confidence) < F.max(confidence)).alias("_many"))
    sliced = sliced.join(F.broadcast(several), "_u")
    sliced = sliced.withColumn("_t", F.when(F.col("_many"), F.lit(None)).otherwise(F.col("_t")))
    before = Window.orderBy("_u", "_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("_u", "_t").agg(F.count("*").alias("_n")).select(F.col("_u").alias("_v"), F.col("_t").alias("_w"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_u", "_t").orderBy(F.desc(confidence), row_id))
    joined = sliced.withColumn("_in", inside).join(counts, (F.col("_u") == F.col("_v")) & F.col("_t").eqNullSafe(F.col("_w")))
    return joined.select(*rows.columns, (F.col("_in") + F.col("_before")).alias("_place"))


def id_slice(rows: DataFrame, row_id: str, slices: int = 256) -> Column:
    """A slice of the row ids, rising with them: equal ranges of numbers, first letters of texts."""
    if not isinstance(rows.schema[row_id].dataType, T.NumericType):
        return F.substring(F.col(row_id).cast("string"), 1, 2)
    low, high = rows.agg(F.min(row_id).cast("double"), F.max(row_id).cast("double")).first()
    if low is None or high <= low:
        return F.lit(0).cast("long")
    return F.floor((F.col(row_id).cast("double") - F.lit(low)) / F.lit(high - low) * slices)


def select_empirical(rows: DataFrame, row_id: str, pi: float, confidence: str = "confidence", share: float = EMPIRICAL) -> DataFrame:
    """Rows for the coreset with pseudo_label: the surest fifth of the predicted positives, and of the negatives.

    A fifth that rounds to none selects none.
    """
    n = rows.count()
    n_pos = int(n * pi)
    top, bottom = int(share * n_pos), int(share * (n - n_pos))
    placed = confidence_ranks(rows, row_id, confidence)
    label = F.when(F.col("_place") <= top, 1).when(F.col("_place") > n - bottom, 0)
    return placed.withColumn("pseudo_label", label).filter("pseudo_label is not null").drop("_place")


def select_balanced(rows: DataFrame, row_id: str, pi: float, confidence: str = "confidence", share: float = EMPIRICAL) -> DataFrame:
    """As many of each end: a fifth of the smaller side."""
    n = rows.count()
    n_pos = int(n * pi)
    step = int(share * min(n_pos, n - n_pos))
    placed = confidence_ranks(rows, row_id, confidence)
    label = F.when(F.col("_place") <= step, 1).when(F.col("_place") > n - step, 0)
    return placed.withColumn("pseudo_label", label).filter("pseudo_label is not null").drop("_place")


def select_incremental(rows: DataFrame, row_id: str, pi: float, low: float, high: float, confidence: str = "confidence") -> DataFrame:
    """Predicted positives at least as sure as any before, predicted negatives at least as unsure."""
    n_pos = int(rows.count() * pi)
    placed = confidence_ranks(rows, row_id, confidence)
    c = F.col(confidence)
    label = F.when((F.col("_place") <= n_pos) & (c >= high), 1).when((F.col("_place") > n_pos) & (c <= low), 0)
    return placed.withColumn("pseudo_label", label).filter("pseudo_label is not null").drop("_place")


def structural_probability(positive: float, negative: float) -> float:
    """``structural_confidence`` of two numbers."""
    near, far = (0.0 if math.isinf(d) else 1 / (d + EPS) for d in (positive, negative))
    return near / (near + far) if near + far else 0.5


def weighted_features(importance: dict[str, float], names: Sequence[str]) -> list[Column]:
    """Feature columns scaled by importance."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(float(importance.get(n, 0.0))) for n in names]
