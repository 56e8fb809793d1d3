"""Random forests for small labelled samples, in NumPy; scored on tables of any size by plain SQL expressions.

Gini splits, bootstrap rows, the square root of the features tried at each split, sample weights. Semantics follow
the usual parameters; trees are not bit for bit those of another library.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weights import balanced_weights, subjective_penalty, weighted_loss


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 50
    depth: int = 3
    min_leaf: int = 2


#: Forest of the confidence estimates.
CONFIDENCE = ForestConfig(100, 10, 1)


def depth_grid(most: int = 3) -> list[ForestConfig]:
    return [ForestConfig(depth=d) for d in range(1, most + 1)]


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; a leaf's feature is -1, and its value the share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (live := self.feature[node] >= 0).any():
            at = node[live]
            down = x[live, self.feature[at]] <= self.threshold[at]
            node[live] = np.where(down, self.left[at], self.right[at])
        return self.value[node]


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, min_leaf: int, counts: np.ndarray | None = None) -> tuple[float, float]:
    """(gain, threshold) of one feature: largest drop of weighted Gini impurity; gain 0 if there is none."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    c = np.ones(len(x)) if counts is None else counts[order]
    total, ones, seen = np.cumsum(w), np.cumsum(w * y), np.cumsum(c)
    cut = np.flatnonzero(x[1:] > x[:-1])
    cut = cut[(seen[cut] >= min_leaf) & (seen[-1] - seen[cut] >= min_leaf)]
    if not len(cut):
        return 0.0, 0.0

    def impurity(mass, one):
        return np.where(mass > 0, 2 * one * (mass - one) / np.maximum(mass, 1e-300), 0.0)

    gain = impurity(total[-1], ones[-1]) - impurity(total[cut], ones[cut]) - impurity(total[-1] - total[cut], ones[-1] - ones[cut])
    best = int(np.argmax(gain))
    return float(gain[best]), float((x[cut[best]] + x[cut[best] + 1]) / 2)


def _grow(x, y, w, config: ForestConfig, rng, importance: np.ndarray) -> Tree:
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at, mass = len(nodes), w[rows].sum()
        share = float((w[rows] * y[rows]).sum() / mass) if mass > 0 else 0.0
        nodes.append([-1, 0.0, 0, 0, share])
        if depth >= config.depth or len(rows) < 2 * config.min_leaf or share in (0.0, 1.0):
            return at
        tried, found = 0, (0.0, 0.0, -1)
        for f in rng.permutation(x.shape[1]):
            gain, threshold = best_split(x[rows, f], y[rows], w[rows], config.min_leaf)
            if gain > found[0] + 1e-12:
                found = (gain, threshold, int(f))
            tried += 1
            if tried >= max(1, int(np.sqrt(x.shape[1]))) and found[2] >= 0:
                break
        gain, threshold, f = found
        if f < 0:
            return at
        importance[f] += gain
        down = x[rows, f] <= threshold
        nodes[at][:2] = [f, threshold]
        nodes[at][2] = add(rows[down], depth + 1)
        nodes[at][3] = add(rows[~down], depth + 1)
        return at

    add(np.arange(len(y)), 0)
    a = np.array(nodes, float)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


@dataclass(frozen=True)
class Forest:
    names: tuple[str, ...]
    trees: tuple[Tree, ...]
    importances: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.probability(x) > 0.5).astype(int)

    def sql(self, quote: str = "`", number: str = "{!r}D") -> str:
        """P(label = 1) as one SQL expression of the feature columns; missing values count as zero. Equal trees, and so
        those of one leaf, are written once with their number."""
        name = lambda f: f"coalesce(cast({quote}{self.names[f]}{quote} as double), {number.format(0.0)})"

        def node(tree: Tree, at: int) -> str:
            if tree.feature[at] < 0:
                return number.format(float(tree.value[at]))
            return f"CASE WHEN {name(tree.feature[at])} <= {number.format(float(tree.threshold[at]))} THEN {node(tree, tree.left[at])} ELSE {node(tree, tree.right[at])} END"

        times: dict[str, int] = {}
        for text in (node(t, 0) for t in self.trees):
            times[text] = times.get(text, 0) + 1
        total = " + ".join(f"{number.format(float(k))} * ({text})" for text, k in times.items())
        return f"({total}) / {number.format(float(len(self.trees)))}"

    def column(self) -> Column:
        """P(label = 1) of a row, from its feature columns: a plain expression, without Python workers."""
        return F.expr(self.sql())


def train(x: np.ndarray, y: np.ndarray, names: list[str], config: ForestConfig = CONFIDENCE, weight: np.ndarray | None = None, seed: int = 42) -> Forest:
    """A forest; a single class gives a constant one."""
    x, y = np.asarray(x, float).reshape(len(y), len(names)), np.asarray(y, float)
    if not len(y):
        raise ValueError("a forest needs labelled rows")
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    rng, importance, trees = np.random.default_rng(seed), np.zeros(len(names)), []
    for _ in range(config.trees if len(set(y)) > 1 and names else 1):
        rows = rng.integers(0, len(y), len(y)) if len(set(y)) > 1 else np.arange(len(y))
        own = np.zeros(len(names))
        trees.append(_grow(x[rows], y[rows], w[rows], config, rng, own))
        importance += own / own.sum() if own.sum() > 0 else own
    total = importance.sum()
    return Forest(tuple(names), tuple(trees), importance / total if total > 0 else importance)


def importances(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 42) -> dict[str, float]:
    """Importance of each feature under class-balanced weights."""
    return dict(zip(names, train(x, y, names, CONFIDENCE, balanced_weights(y), seed).importances.tolist(), strict=True))


def leave_one_out(x: np.ndarray, y: np.ndarray, names: list[str], config: ForestConfig, step: int = 1, seed: int = 42) -> np.ndarray:
    """Places left out (every ``step``-th) and the label predicted for each by a forest on all others."""
    kept = list(range(0, len(y), step))
    guess = [int(train(np.delete(x, i, 0), np.delete(y, i), names, config, seed=seed).predict(x[i : i + 1])[0]) for i in kept]
    return np.array([kept, guess])


def subjective_error(x: np.ndarray, y: np.ndarray, names: list[str], queries: int, delta: float, step: int = 1, config: ForestConfig = ForestConfig(), seed: int = 42) -> tuple[float, float]:
    """(leave-one-out loss, penalty) over labelled rows; zeros with fewer than two rows or no feature."""
    if len(y) < 2 or not names:
        return 0.0, 0.0
    pi = float(np.mean(y))
    kept, guess = leave_one_out(np.asarray(x, float), np.asarray(y), names, config, step, seed)
    return weighted_loss(np.asarray(y)[kept], guess, pi), subjective_penalty(len(y), pi, queries, delta)


def choose_depth(losses: list[float], n: int, step: int = 1) -> int:
    """Index of the shallowest forest whose loss is within one left-out row of the least."""
    resolution = 1 / -(-n // step) if n else 0.0
    return next(i for i, loss in enumerate(losses) if loss <= min(losses) + resolution + 1e-12)


def loo_grid(labelled: pd.DataFrame, names: list[str], spark, queries: int, delta: float, step: int = 1, seed: int = 42, candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """candidate, depth, loss, penalty: the whole grid in one job, a task for each candidate's set of features and depth.

    The labelled sample is bounded by the labelling budget, so it travels with the function.
    """
    candidates = candidates or {"all": names}
    table = {c: labelled[f].to_numpy(float) for c, f in candidates.items()}
    y = labelled["label"].to_numpy(int)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, g = pdf["candidate"].iloc[0], ForestConfig(depth=int(pdf["depth"].iloc[0]))
        rows = [(c, g.depth, *subjective_error(table[c], y, candidates[c], queries, delta, step, g, seed))]
        return pd.DataFrame(rows, columns=["candidate", "depth", "loss", "penalty"])

    cells = [(c, g.depth) for c in candidates for g in depth_grid()]
    grid = spark.createDataFrame(cells, "candidate string, depth int").repartition(len(cells), "candidate", "depth")
    return grid.groupBy("candidate", "depth").applyInPandas(run, "candidate string, depth int, loss double, penalty double")


def propagate(rows: DataFrame, forest: Forest | None, name: str = "propagated") -> DataFrame:
    """``rows`` with predicted labels, all batches at once; without features every row is accepted."""
    if forest is None or not forest.names:
        return rows.withColumn(name, F.lit(1))
    return rows.withColumn(name, (forest.column() > 0.5).cast("int"))
