"""Gradient-boosted trees: logistic loss, depth-limited trees, thresholds at quantiles.

``fit`` takes small bounded tables, ``fit_blocks`` rows of any number that lie with the tasks.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark import RDD

UNIT = 1 << 20  # gradients are summed as whole numbers of this part, so that sums don't depend on their order

# Rows of a distributed fit: (bin of each feature, label, how often the row occurs).
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def leaves(bins: np.ndarray, feature: np.ndarray, bound: np.ndarray, levels: int) -> np.ndarray:
    """The node each row reaches after so many levels; rows of bins up to a node's bound go left."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        node = np.where(bins[rows, feature[node]] <= bound[node], 2 * node + 1, 2 * node + 2)
    return node


def histogram(block: Block, trees: list, base: float, feature: np.ndarray, bound: np.ndarray, level: int, size: int) -> np.ndarray:
    """Gradients and weights by (node of the level, feature, bin), as whole numbers of 1 / UNIT."""
    bins, y, n = block
    score = np.full(len(y), base)
    for f, b, value in trees:
        score += value[leaves(bins, f, b, len(value).bit_length() - 1) - len(f)]
    p = 1 / (1 + np.exp(-score))
    node = leaves(bins, feature, bound, level) - (2**level - 1)
    out = np.zeros((2, 2**level, bins.shape[1], size), np.int64)
    for k, v in enumerate((y - p, p * (1 - p))):
        whole = np.rint(v * UNIT) * n
        for j in range(bins.shape[1]):
            out[k, :, j] = np.bincount(node * size + bins[:, j], whole, minlength=2**level * size).reshape(-1, size).astype(np.int64)
    return out


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))[:-1] for j in range(x.shape[1])]
        below = [x[:, j][:, None] <= c[None, :] for j, c in enumerate(cuts)]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            # a full tree: node k has the children 2k + 1 and 2k + 2; a node without a split sends all rows left
            inner = 2**self.depth - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf)
                if len(rows) > 1:
                    g, h = gradient[rows].sum(), weight[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        left = below[j][rows]
                        gl, hl = gradient[rows] @ left, weight[rows] @ left
                        gain = gl**2 / (hl + self.least) + (g - gl) ** 2 / (h - hl + self.least) - g**2 / (h + self.least)
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, float(c[i]))
                feature[k], threshold[k] = best[1:]
                node[rows] = np.where(x[rows, feature[k]] <= threshold[k], 2 * k + 1, 2 * k + 2)
            leaf = node - inner
            g, h = (np.bincount(leaf, v, minlength=inner + 1) for v in (gradient, weight))
            value = self.rate * g / (h + self.least)
            self.trees.append((feature, threshold, value))
            score = score + value[leaf]
        return self

    def fit_blocks(self, blocks: RDD, cuts: list[np.ndarray]) -> BoostedTrees:
        """The fit of ``fit`` on blocks of binned rows (bin i: above i of the feature's cuts); the driver sees histograms only."""
        ones, total = blocks.map(lambda b: np.array([b[2] @ b[1], b[2].sum()], float)).treeReduce(np.add)
        share = np.clip(ones / total, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        size = max(map(len, cuts)) + 1
        real = np.array([[i < len(c) for i in range(size)] for c in cuts])  # the bins that end at a cut
        inner, binned = 2**self.depth - 1, []
        for _ in range(self.rounds):
            feature, bound, threshold = np.zeros(inner, np.int64), np.full(inner, size), np.full(inner, np.inf)
            value = np.zeros(inner + 1)
            for level in range(self.depth):
                whole = blocks.map(partial(histogram, trees=binned, base=self.base, feature=feature, bound=bound, level=level, size=size)).treeReduce(np.add)
                for at, (g_bins, h_bins) in enumerate(zip(*(whole / UNIT), strict=True)):
                    k, g, h = 2**level - 1 + at, g_bins[0].sum(), h_bins[0].sum()
                    gl, hl = g_bins.cumsum(1), h_bins.cumsum(1)
                    gain = np.where(real, gl**2 / (hl + self.least) + (g - gl) ** 2 / (h - hl + self.least) - g**2 / (h + self.least), -np.inf)
                    j, i = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    left = (g, h)
                    if gain[j, i] > 1e-9:
                        feature[k], bound[k], threshold[k] = j, i, cuts[j][i]
                        left = (gl[j, i], hl[j, i])
                    if level == self.depth - 1:
                        for side, (a, b) in enumerate((left, (g - left[0], h - left[1]))):
                            value[2 * k + 1 + side - inner] = self.rate * a / (b + self.least)
            binned.append((feature, bound, value))
            self.trees.append((feature, threshold, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= threshold[node], 2 * node + 1, 2 * node + 2)
            out += value[node - len(feature)]
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept. ``y`` may be soft."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = np.ones(len(x)) if weight is None else weight
    out = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ out, -30, 30)))
        slope = design.T @ (weight * (y - p)) - penalty * out
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        out += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return out
