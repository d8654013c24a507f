"""Gradient-boosted trees for several classes, with binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """rounds x classes complete trees of one depth: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        depth = int(np.log2(self.value.shape[-1]))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            for k in range(len(self.base)):
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (x[rows, feature[k][at]] > cut[k][at])
                out[:, k] += value[k][at - (2**depth - 1)]
        return out

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Log of each class's share."""
        m = self.margins(x)
        m -= m.max(axis=1, keepdims=True)
        return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


def fit_forest(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.25, leaf: float = 1.0, n_bins: int = 32) -> Forest:
    """Newton boosting of the softmax loss, a tree for each class and round; splits by the gain over
    histograms of at most ``n_bins`` quantile bins a feature."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(d)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = codes + np.arange(d) * n_bins
    share = np.bincount(y, minlength=classes) / n
    base = np.log(np.maximum(share, 1e-6))
    margin = np.tile(base, (n, 1))
    inner = 2**depth - 1
    feature, cut, value = np.zeros((rounds, classes, inner), np.int64), np.full((rounds, classes, inner), np.inf), np.zeros((rounds, classes, inner + 1))
    for t in range(rounds):
        p = np.exp(margin - margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                index = ((at - first)[:, None] * (d * n_bins) + flat).ravel()
                gs, hs = (np.bincount(index, np.repeat(v, d), minlength=width * d * n_bins).reshape(width, d, n_bins) for v in (g, h))
                gl, hl = np.cumsum(gs, 2)[:, :, :-1], np.cumsum(hs, 2)[:, :, :-1]
                gt, ht = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
                gain = gl**2 / (hl + leaf) + (gt - gl) ** 2 / (ht - hl + leaf) - gt**2 / (ht + leaf)
                best = gain.reshape(width, -1).argmax(1)
                for w in range(width):
                    j, b = divmod(int(best[w]), n_bins - 1)
                    if gain[w, j, b] > 1e-6 and b < len(edges[j]):
                        feature[t, k, first + w], cut[t, k, first + w] = j, edges[j][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[t, k, at]] > cut[t, k, at])
            leaves = at - inner
            gs, hs = np.bincount(leaves, g, minlength=inner + 1), np.bincount(leaves, h, minlength=inner + 1)
            value[t, k] = -rate * gs / (hs + leaf)
            margin[:, k] += value[t, k, leaves]
    return Forest(feature, cut, value, base)
