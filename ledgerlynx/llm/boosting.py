"""Gradient-boosted trees for two classes over small float matrices, with numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth: node k has the children 2k + 1 and 2k + 2; leaves come last."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Logistic boosting; splits are sought among quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total, inner = np.full(n, base), 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows):
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    gl = np.bincount(binned[rows, j], weights=g[rows], minlength=len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(binned[rows, j], weights=h[rows], minlength=len(e) + 1).cumsum()[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, feature[k], cut[k] = gain[at], j, e[at]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        slot = node - inner
        leaf = rate * np.bincount(slot, weights=g, minlength=inner + 1) / (np.bincount(slot, weights=h, minlength=inner + 1) + ridge)
        total += leaf[slot]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, np.stack(features), np.stack(cuts), np.stack(leaves))


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of class 1 is at least `precision`; above all scores if none is."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_score = np.append(np.diff(scores[order]) != 0, True) if len(y) else np.empty(0, bool)
    good = np.flatnonzero((share >= precision) & last_of_score)
    return float(scores[order[good[-1]]]) if len(good) else 2.0
