"""Error certificates of rewrites, their bound on F1, and how both move as batches arrive."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import shuffle_key


def hypergeometric_cdf(x: int, population: int, marked: int, drawn: int) -> float:
    """P(at most ``x`` marked among ``drawn`` of ``population``)."""
    low, high = max(0, drawn - (population - marked)), min(drawn, marked)
    if x < low:
        return 0.0
    if x >= high:
        return 1.0
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    whole = log_choose(population, drawn)
    return min(1.0, math.fsum(math.exp(log_choose(marked, i) + log_choose(population - marked, drawn - i) - whole) for i in range(low, x + 1)))


def most_errors(population: int, drawn: int, seen: int, alpha: float) -> int:
    """The largest number of errors in the population that ``seen`` errors among ``drawn`` don't refute at ``alpha``."""
    low, high = 0, max(0, population)
    while low < high:  # the probability falls as the number of errors rises
        mid = (low + high + 1) // 2
        low, high = (mid, high) if hypergeometric_cdf(seen, population, mid, drawn) > alpha else (low, mid - 1)
    return low


@dataclass(frozen=True)
class Certificate:
    """``bound`` on the share of wrong rows, and what it is made of."""

    bound: float
    disagreement: float
    training_errors: int
    unseen_errors: int
    candidates: int


def certificate(candidates: int, disagreeing: int, training: int, training_errors: int, verified: int, verified_errors: int, delta: float, queries: int) -> Certificate:
    """Bound = disagreement of probe and final rules + errors seen in training and possible among the rest."""
    if candidates <= 0:
        return Certificate(0.0, 0.0, training_errors, 0, 0)
    unseen = most_errors(candidates - training, verified, verified_errors, delta / queries)
    d = disagreeing / candidates
    return Certificate(min(1.0, d + (training_errors + unseen) / candidates), d, training_errors, unseen, candidates)


def f1_bound(bound: float, pi: float) -> float:
    """Least F1 that an error share of ``bound`` allows at selectivity ``pi``."""
    return 2 * (pi - bound) / (2 * pi - bound) if bound < pi else 0.0


def f1_bound_column(bound: Column | float, pi: Column) -> Column:
    """``f1_bound`` of columns."""
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(bound < pi, 2 * (pi - bound) / (2 * pi - bound)).otherwise(F.lit(0.0))


def split_annotations(labelled: DataFrame, row_id: str, seed: int, ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Training and verification rows in a seeded order; ``int(ratio * m + 0.5)`` of m train."""
    m = labelled.count()
    ids = [r[0] for r in labelled.select(row_id).orderBy(shuffle_key(seed, row_id), row_id).limit(int(ratio * m + 0.5)).collect()]
    chosen = F.col(row_id).isin(ids) if ids else F.lit(False)
    return labelled.filter(chosen), labelled.filter(~chosen)


@dataclass(frozen=True)
class Update:
    data_error: float
    prediction_error: float
    bound: float


def updated_certificate(previous_size: int, current_size: int, bound: float, changed: int, labelled: int, selected_true: int) -> Update:
    """The certificate after a batch. Sizes are those of the previous and the current batch's candidates; ``changed``
    counts old labels that the new model changes, out of ``labelled`` rows and the annotated true ones."""
    whole = previous_size + current_size
    if not whole:
        return Update(0.0, 0.0, bound)
    data = current_size / whole
    n = labelled + selected_true
    prediction = changed / n if n else 0.0
    return Update(data, prediction, min(1.0, previous_size / whole * bound + data + prediction))


def smoothed(update: Update, previous: float) -> float:
    """What is compared with the threshold: new errors and half of what was certified before."""
    return update.data_error + update.prediction_error + 0.5 * previous


def reoptimisation_threshold(sizes: list[int], delta: float) -> float:
    """Share of new rows plus a sampling margin; infinite with fewer than two batches or an empty side."""
    if len(sizes) < 2 or not sum(sizes[:-1]) or not sizes[-1]:
        return math.inf
    before = sum(sizes[:-1])
    return sizes[-1] / (before + sizes[-1]) + math.sqrt(math.log(2 / delta) / (2 * before))
