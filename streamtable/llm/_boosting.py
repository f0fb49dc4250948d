"""Gradient-boosted trees for two classes, on whole numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of a fixed depth over binned features, as arrays: feature and bin of each inner node, value of each leaf."""

    def __init__(self, edges: list[np.ndarray], base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.edges, self.base, self.feature, self.cut, self.value = edges, base, feature, cut, value

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        depth = int(np.log2(self.value.shape[1]))
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[row, f[node]] > c[node])
            score += v[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Boosting on the logistic loss; every split has the largest gain over the histograms of all features."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
    out = Trees(edges, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 2**depth)))
    b = out.binned(x).astype(np.int64)
    flat = b + np.arange(k) * BINS
    score = np.full(n, out.base)
    inner = 2**depth - 1
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (k * BINS) + flat).ravel()
            shape = (width, k, BINS)
            sg = np.bincount(cell, np.repeat(g, k), width * k * BINS).reshape(shape).cumsum(axis=2)
            sh = np.bincount(cell, np.repeat(h, k), width * k * BINS).reshape(shape).cumsum(axis=2)
            tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
            gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
            gain[(sh < least) | (th - sh < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            use = gain.reshape(width, -1).max(axis=1) > 1e-9
            features[t, first : first + width] = best // BINS
            cuts[t, first : first + width] = np.where(use, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), features[t, node]] > cuts[t, node])
        leaf = node - inner
        values[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += values[t, leaf]
    out.feature, out.cut, out.value = features, cuts, values
    return out
