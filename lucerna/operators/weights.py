"""Sample weights, selectivity estimates and losses: small aggregates joined back, and the same sums on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Classes or strata that weights are given for, at most.
MOST_CLASSES = 1000


def class_balanced(df: DataFrame, label: str = "label", weight: str | None = None, name: str = "weight") -> DataFrame:
    """Weights with the same mass, 1 / number of classes, for every class."""
    base = F.col(weight) if weight else F.lit(1.0)
    masses = {r["l"]: r["m"] for r in df.groupBy(F.col(label).alias("l")).agg(F.sum(base).alias("m")).limit(MOST_CLASSES + 1).collect()}
    if len(masses) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    classes = float(max(1, len(set(masses) - {None})))
    return df.withColumn(name, base / (_by_value(df, label, masses) * F.lit(classes)))


def balanced_weights(labels: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """The same for a labelled sample on the driver."""
    w = np.ones(len(labels)) if base is None else np.asarray(base, float)
    values, which = np.unique(labels, return_inverse=True)
    return w / (np.bincount(which, w)[which] * len(values)) if len(w) else w


def sampling_weights(df: DataFrame, stratum: str, population: Column, name: str = "weight") -> DataFrame:
    """Inverse inclusion rates, population over sample of each stratum, with mean one."""
    sums = df.groupBy(F.col(stratum).alias("l")).agg(F.count("*").alias("n"), F.sum(population).alias("p")).limit(MOST_CLASSES + 1).collect()
    if len(sums) > MOST_CLASSES:
        raise ValueError(f"{stratum} has more than {MOST_CLASSES} values")
    n, mass = sum(r["n"] for r in sums), sum((r["p"] or 0) / r["n"] for r in sums)
    raw = population / _by_value(df, stratum, {r["l"]: r["n"] for r in sums})
    return df.withColumn(name, raw / F.lit(mass / n)) if n and mass else df.withColumn(name, raw)


def _by_value(df: DataFrame, column: str, values: dict) -> Column:
    """What ``values`` has for the column's value: a projection, so that no class meets in one task."""
    out = F.lit(None).cast("double")
    for key, value in values.items():
        test = F.col(column).isNull() if key is None else F.col(column) == F.lit(key)
        out = F.when(test, F.lit(float(value))).otherwise(out)
    return out


def beta_selectivity(positive: tuple[int, int, int], negative: tuple[int, int, int]) -> float:
    """Stratified selectivity with a uniform prior; each stratum is (population, sampled, true among them)."""
    whole = positive[0] + negative[0]
    return sum(pop / whole * (1 + true) / (2 + sampled) for pop, sampled, true in (positive, negative))


def selectivity_table(sampled: DataFrame, stratum: str = "stratum", population: str = "population_size", label: str = "label") -> DataFrame:
    """The same as one row, selectivity: null unless there are exactly two strata."""
    each = sampled.groupBy(stratum).agg(F.max(population).alias("pop"), F.count("*").alias("n"), F.count(F.when(F.col(label), 1)).alias("t"))
    part = F.col("pop") * (1 + F.col("t")) / (2 + F.col("n"))
    return each.agg(F.when(F.count("*") == 2, F.sum(part) / F.sum("pop")).alias("selectivity"))


def clipped(pi: float) -> float:
    return min(max(pi, 1e-6), 1 - 1e-6)


def weighted_loss_column(truth: Column, guess: Column, pi: float) -> Column:
    """Cost of a row: a miss costs max(pi, 1 - pi) / pi, a false hit max(pi, 1 - pi) / (1 - pi)."""
    pi = clipped(pi)
    top = max(pi, 1 - pi)
    return F.when((truth == 1) & (guess == 0), F.lit(top / pi)).when((truth == 0) & (guess == 1), F.lit(top / (1 - pi))).otherwise(F.lit(0.0))


def weighted_loss(truth: np.ndarray, guess: np.ndarray, pi: float) -> float:
    truth, guess, pi = np.asarray(truth), np.asarray(guess), clipped(pi)
    if len(truth) != len(guess):
        raise ValueError("as many guesses as labels are needed")
    if not len(truth):
        return 0.0
    top = max(pi, 1 - pi)
    return float(np.where((truth == 1) & (guess == 0), top / pi, np.where((truth == 0) & (guess == 1), top / (1 - pi), 0.0)).mean())


def _spread(pi: float) -> float:
    pi = clipped(pi)
    return max(pi, 1 - pi) / min(pi, 1 - pi)


def subjective_penalty(n: int, pi: float, queries: int, delta: float) -> float:
    return _spread(pi) * math.sqrt(math.log(2 * queries / delta) / (2 * n)) if n else 0.0


def objective_penalty(n: int, pi: float, b_rew: int, arity: int, queries: int, delta: float) -> float:
    dimension = b_rew * max(1, arity) * math.log(b_rew)
    return _spread(pi) * math.sqrt((dimension * math.log(n) + math.log(2 * queries / delta)) / n) if n else 0.0
