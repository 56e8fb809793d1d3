"""A linear-chain conditional random field over hashed features, in NumPy: likelihood, gradient and Viterbi.

Chains come padded; places beyond a chain's length are outside and add nothing. No chain at all gives an empty array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
#: Score of what can't be: inside after outside, or at a start.
NEVER = -1e4


@dataclass(frozen=True)
class Crf:
    """``weights`` by (feature, tag); ``moves`` by (tag before, tag); ``starts`` by tag. Feature 0 is padding."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    @classmethod
    def zero(cls, n_features: int) -> Crf:
        moves, starts = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        moves[OUTSIDE, INSIDE] = starts[INSIDE] = NEVER
        return cls(np.zeros((n_features, TAGS)), moves, starts)

    def emissions(self, ids: np.ndarray, kind: type = np.float64) -> np.ndarray:
        """Scores (..., tag) of tokens with feature ids (..., slot)."""
        weights = self.weights.astype(kind)
        out = weights.take(ids[..., 0], axis=0)
        for slot in range(1, ids.shape[-1]):  # a slot at a time: less memory than all at once
            out += weights.take(ids[..., slot], axis=0)
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (chain, token) of padded chains; places beyond a chain's length are outside."""
        scores = self.emissions(ids, np.float32)
        n, t_max, _ = scores.shape
        best, back = self.starts + scores[:, 0], np.zeros((n, t_max, TAGS), np.int8)
        shortest = int(lengths.min(initial=t_max))
        for t in range(1, t_max):
            through = best[:, :, None] + self.moves
            back[:, t] = through.argmax(axis=1)
            new = through.max(axis=1) + scores[:, t]
            best = new if t < shortest else np.where((t < lengths)[:, None], new, best)
        tags, now = np.zeros((n, t_max), np.int8), best.argmax(axis=1)
        for t in range(t_max - 1, -1, -1):
            live = t < lengths
            tags[live, t] = now[live]
            if t:
                now = np.where(live, back[np.arange(n), t, now], now)
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(model: Crf, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, Crf]:
    """Mean log-likelihood of the tags of padded chains, and its gradient in the shape of a model."""
    scores = model.emissions(ids)
    n, t_max, _ = scores.shape
    live = np.arange(t_max) < lengths[:, None]
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = model.starts + scores[:, 0]
    for t in range(1, t_max):
        new = _log_sum(ahead[:, t - 1, :, None] + model.moves, 1) + scores[:, t]
        ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
    for t in range(t_max - 2, -1, -1):
        new = _log_sum(model.moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(live[:, t + 1, None], new, 0)
    total = _log_sum(ahead[:, -1], 1)
    single = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
    pairs = np.zeros((TAGS, TAGS))
    gold = np.eye(TAGS)[tags] * live[..., None]
    gold_pairs = np.zeros((TAGS, TAGS))
    for t in range(1, t_max):
        both = ahead[:, t - 1, :, None] + model.moves + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
        pairs += (np.exp(both) * live[:, t, None, None]).sum(axis=0)
        gold_pairs += np.einsum("na,nb->ab", gold[:, t - 1], gold[:, t])
    value = (scores * gold).sum() + (gold_pairs * model.moves).sum() + (gold[:, 0] * model.starts).sum() - total.sum()
    miss = gold - single
    grad = np.stack([np.bincount(ids.ravel(), np.repeat(miss[..., k].ravel(), ids.shape[-1]), len(model.weights)) for k in range(TAGS)], axis=1)
    return value / n, Crf(grad / n, (gold_pairs - pairs) / n, (gold[:, 0] - single[:, 0]).sum(axis=0) / n)


def train(ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, n_features: int, rounds: int = 80, rate: float = 0.15, penalty: float = 1e-5) -> Crf:
    """Adam on the penalised likelihood; weight of feature 0 (padding) stays zero."""
    model = Crf.zero(n_features)
    parts = ["weights", "moves", "starts"]
    first = {p: np.zeros_like(getattr(model, p)) for p in parts}
    second = {p: np.zeros_like(getattr(model, p)) for p in parts}
    for k in range(1, rounds + 1):
        _, grad = likelihood(model, ids, tags, lengths)
        for p in parts:
            x, g = getattr(model, p), getattr(grad, p) - penalty * getattr(model, p)
            first[p] = 0.9 * first[p] + 0.1 * g
            second[p] = 0.99 * second[p] + 0.01 * g * g
            step = rate * (first[p] / (1 - 0.9**k)) / (np.sqrt(second[p] / (1 - 0.99**k)) + 1e-8)
            x += np.where(x <= NEVER / 2, 0, step)
        model.weights[0] = 0
    return model
