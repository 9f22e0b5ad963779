"""Histogram gradient-boosted trees for a 0/1 label, kept as flat arrays and scored by vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node ``i`` has children ``2i + 1`` and ``2i + 2``; the last level holds the leaves.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, leaves); a row goes right
    where its value is above the threshold (an unsplit node has threshold infinity: all go left).
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of every column: midpoints of neighbouring quantiles, so equal values share a bin."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        l2: float = 1.0, min_hessian: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over per-node histograms of gradients and hessians.

    Without rows, or with one class only, the model is a constant (a smoothed base rate).  Ties between
    splits go to the first feature and the lowest cut, so refits agree.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate0 / (1 - rate0)))
    feature, threshold, leaf = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    cuts = _edges(x, bins)
    width = bins + 1
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * width + binned[f]
                g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(1)
                gl, hl, ga, ha = g[:, :len(c)], h[:, :len(c)], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < min_hessian) | (ha - hl < min_hessian)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[t, first + better], threshold[t, first + better] = f, c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= inner
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        leaf[t] = -rate * g / (h + l2)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)
