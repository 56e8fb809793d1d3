"""Rewriting a semantic predicate: propagated labels become a short union of interval rules over plain columns.

Candidates are counted in Spark by the bins of their features; a best-first tree with one leaf more than the rule
budget is grown over those counts, and its positive leaves become the rules. The result is an ordinary filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Rules
from .forest import best_split

#: Distinct rows of binned features that reach the driver, at most; beyond, bins are made coarser.
MOST_TUPLES = 20_000
BINS = (64, 16, 6, 3, 2)


@dataclass(frozen=True)
class Candidate:
    """One way to rewrite: which columns the rules may use."""

    kind: str  # "prefix" or "external_forest"
    features: tuple[str, ...]
    n_external: int


def candidates(ranked: list[str], least: int, base: list[str]) -> list[Candidate]:
    """Prefixes of the ranked features from ``least`` on, each with the base features, and all without them."""
    out = [Candidate("prefix", (*base, *ranked[:n]), n) for n in range(max(0, least), len(ranked) + 1)]
    return out + ([Candidate("external_forest", tuple(ranked), len(ranked))] if base else [])


def least_prefix(ranked: list[str], required: set[str]) -> int:
    """The shortest prefix with every required feature."""
    return max((i + 1 for i, f in enumerate(ranked) if f in required), default=0)


def thresholds(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Cut points of each feature: between its quantiles; few distinct values are all kept apart."""
    if not names:
        return {}
    steps = [i / bins for i in range(bins + 1)]
    values = rows.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]).approxQuantile(names, steps, 0.001)
    return {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in ((n, sorted(set(v))) for n, v in zip(names, values, strict=True))}


def binned_counts(rows: DataFrame, names: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, list[float]]]:
    """(bins, labels, counts) of all candidates, and each feature's cut points."""
    for bins in BINS:
        cuts = thresholds(rows, names, bins)
        cols = [_bin(n, cuts[n]) for n in names]
        grouped = rows.select(*cols, F.col(label).cast("int").alias("_label")).groupBy(*names, "_label").count()
        held = grouped.limit(MOST_TUPLES + 1).collect()
        if len(held) <= MOST_TUPLES or bins == BINS[-1]:
            break
    held = held if len(held) <= MOST_TUPLES else grouped.collect()  # two bins a feature: bounded by the feature budget
    x = np.array([[r[n] for n in names] for r in held], float).reshape(len(held), len(names))
    return x, np.array([r["_label"] for r in held], int), np.array([r["count"] for r in held], float), cuts


def _bin(name: str, cuts: list[float]):
    """Number of cut points below the value."""
    x = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))
    out = F.lit(0)
    for c in cuts:
        out = out + (x > c).cast("int")
    return out.alias(name)


@dataclass
class _Leaf:
    rows: np.ndarray
    bounds: dict[int, tuple[float, float]]  # of bins: (low, high]


def grow_leaves(x: np.ndarray, y: np.ndarray, w: np.ndarray, leaves: int) -> list[_Leaf]:
    """Best-first tree over counted rows: the split with the largest drop of impurity comes first."""
    done = [_Leaf(np.arange(len(y)), {})]

    def split(leaf: _Leaf) -> tuple[float, int, float]:
        best = (0.0, -1, 0.0)
        for f in range(x.shape[1]):
            gain, at = best_split(x[leaf.rows, f], y[leaf.rows], w[leaf.rows], 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, at)
        return best

    splits = [split(done[0])]
    while len(done) < leaves:
        k = max(range(len(done)), key=lambda i: (splits[i][0], -i))
        gain, f, at = splits[k]
        if f < 0:
            break
        leaf = done[k]
        low, high = leaf.bounds.get(f, (-math.inf, math.inf))
        down = x[leaf.rows, f] <= at
        pair = [_Leaf(leaf.rows[down], leaf.bounds | {f: (low, math.floor(at))}), _Leaf(leaf.rows[~down], leaf.bounds | {f: (math.floor(at), high)})]
        done[k : k + 1] = pair
        splits[k : k + 1] = [split(p) for p in pair]
    return done


def canonical(bounds: dict[str, tuple[float, float]]) -> list[tuple[str, float, str]]:
    """Conditions of intervals (low, high], by feature name; the lower bound first."""
    out = []
    for f in sorted(bounds):
        low, high = bounds[f]
        out += [(f, low, ">")] if low > -math.inf else []
        out += [(f, high, "<=")] if high < math.inf else []
    return out


def rule_mask(rule: list[tuple[str, float, str]], x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, t, op in rule:
        v = x[:, names.index(f)]
        hit &= v <= t if op == "<=" else v > t
    return hit


def rules_mask(rules: Rules, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.any([rule_mask(r, x, names) for r in rules], axis=0) if rules else np.zeros(len(x), bool)


def extract_rules(rows: DataFrame, names: list[str], label: str, budget: int, reference: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Rules:
    """At most ``budget`` rules for the labels of the candidates.

    With more positive leaves than the budget, those stay that serve the annotated rows best (``reference``: features,
    labels, weights): most hits less false ones, then least weighted error, then the shortest, then by text.
    """
    if budget <= 0:
        return []
    if not names:
        r = rows.agg(F.avg(F.col(label).cast("double")).alias("m")).first()
        return [[]] if r["m"] is not None and r["m"] >= 0.5 else []
    x, y, n, cuts = binned_counts(rows, names, label)
    if not len(y) or not y.any():
        return []
    if y.all():
        return [[]]
    leaves = [leaf for leaf in grow_leaves(x, y, n, budget + 1) if (n[leaf.rows] * y[leaf.rows]).sum() > n[leaf.rows].sum() / 2]

    def cut(f: int, place: float) -> float:
        # bins hold how many cut points lie below: at most k means at most cut point k
        return place if math.isinf(place) else cuts[names[f]][int(place)]

    rules = {tuple(canonical({names[f]: (cut(f, a), cut(f, b)) for f, (a, b) in leaf.bounds.items()})) for leaf in leaves}
    found = [list(r) for r in sorted(rules, key=repr)]
    if len(found) > budget and reference is not None:
        rx, ry, rw = reference

        def worth(rule):
            hit = rule_mask(rule, rx, names)
            tp, fp = int((hit & (ry == 1)).sum()), int((hit & (ry == 0)).sum())
            return -(tp - fp), float(rw[hit != (ry == 1)].sum()), len(rule), repr(rule)

        found = sorted(found, key=worth)
    return found[:budget]


def arity(rules: Rules) -> int:
    return max(1, len({f for r in rules for f, _, _ in r}))


def best_candidate(losses: list[float]) -> int:
    """Index of the least loss; of equals the later one."""
    return min(range(len(losses)), key=lambda i: (losses[i], -i))

