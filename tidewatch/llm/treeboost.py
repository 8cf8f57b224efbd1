"""Gradient-boosted trees on binned features, for bounded training tables of many thousand rows."""

from __future__ import annotations

import numpy as np


class BinnedTrees:
    """Logistic loss; trees of full depth; a feature is cut at up to ``bins`` quantiles of the training rows."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 5.0, bins: int = 48):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BinnedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        wide = self.bins + 1
        codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # code <= k means x <= cut k
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                own = (node - first) * wide
                best = np.full(n, 1e-9)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    g, h = (np.bincount(own + codes[j], v, minlength=n * wide).reshape(n, wide) for v in (gradient, weight))
                    gl, hl = g.cumsum(1)[:, : len(c)], h.cumsum(1)[:, : len(c)]
                    gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                    gain = gl**2 / (hl + self.least) + (gt - gl) ** 2 / (ht - hl + self.least) - gt**2 / (ht + self.least)
                    at = gain.argmax(1)
                    most = gain[np.arange(n), at]
                    better = np.flatnonzero(most > best)
                    best[better] = most[better]
                    feature[first + better], threshold[first + better] = j, c[at[better]]
                node = np.where(x[np.arange(len(x)), feature[node]] <= threshold[node], 2 * node + 1, 2 * node + 2)
            leaf = node - inner
            g, h = (np.bincount(leaf, v, minlength=inner + 1) for v in (gradient, weight))
            value = self.rate * g / (h + self.least)
            self.trees.append((feature, threshold, value))
            score = score + value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x)) * x.shape[1]
        flat = np.ascontiguousarray(x).reshape(-1)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[rows + feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out
