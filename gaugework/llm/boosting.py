"""Gradient-boosted regression trees with logistic loss, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """A sum of trees of equal depth; node k splits into 2k+1 and 2k+2, leaves follow the inner nodes."""

    bias: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Fits trees one after another to gradient and curvature, rows by weight. One class only, or no rows: a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else 0.01 + 0.98 * float(y[0])
        return Boosted(float(np.log(p / (1 - p))), depth)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1)
    weight = np.ones(n) if weight is None else weight
    share = np.average(y, weights=weight)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    margin, inner = np.full(n, model.bias), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = weight * (y - p), weight * p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            where = node - first
            g0, h0 = np.bincount(where, grad, width), np.bincount(where, curve, width)
            for j in range(d):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                key = where * size + binned[:, j]
                g = np.cumsum(np.bincount(key, grad, width * size).reshape(width, size), 1)[:, :-1]
                h = np.cumsum(np.bincount(key, curve, width * size).reshape(width, size), 1)[:, :-1]
                rest_g, rest_h = g0[:, None] - g, h0[:, None] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - (g0**2 / (h0 + ridge))[:, None]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = cuts[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        where = node - inner
        leaf = rate * np.bincount(where, grad, inner + 1) / (np.bincount(where, curve, inner + 1) + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
        margin += leaf[where]
    return model
