"""Gradient-boosted trees for a yes-or-no label, in numpy, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth: split features, thresholds, and leaf values; a sum of leaves is a log-odds."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)  # per tree: 2**depth - 1 features
    limits: list[np.ndarray] = field(default_factory=list)  # goes right if the value is greater
    leaves: list[np.ndarray] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > limit[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Boost ``trees`` trees on log-loss with second-order leaf values; ``x`` is (rows, features), ``y`` 0 or 1."""
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: greater than cut b - 1
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        f, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first = 2**level - 1
            for n in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == n)
                if len(rows) < 2:
                    continue
                gain, pick = 1e-6, None
                all_g, all_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    sums = [np.bincount(binned[rows, j], w[rows], len(c) + 1).cumsum()[:-1] for w in (g, h)]
                    value = sums[0] ** 2 / (sums[1] + ridge) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + ridge) - all_g**2 / (all_h + ridge)
                    if len(value) and value.max() > gain:
                        gain, pick = value.max(), (j, float(c[value.argmax()]))
                if pick:
                    f[n], limit[n] = pick
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > limit[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        score += leaf[at]
        model.features.append(f)
        model.limits.append(limit)
        model.leaves.append(leaf)
    return model


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float, least: float) -> float:
    """The smallest threshold of at least ``least`` above which the share of ones is at least ``precision``; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_value = np.append(p[order][1:] != p[order][:-1], True)
    fine = np.flatnonzero((share >= precision) & last_of_value & (p[order] >= least))
    return float(p[order][fine[-1]]) if len(fine) else 1.1
