"""A random forest for a few dozen numeric features: histogram splits, bootstrap rows, random feature subsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1: leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            rows, nodes = np.flatnonzero(inner), at[inner]
            goes_left = x[rows, self.feature[nodes]] <= self.threshold[nodes]
            at[rows] = np.where(goes_left, self.left[nodes], self.right[nodes])


def _best_split(bins: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, width: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the split with the least weighted Gini impurity."""
    total, positive = w.sum(), (w * y).sum()
    before = positive * (total - positive) / total
    best = (0.0, -1, -1)
    for f in features:
        n = np.cumsum(np.bincount(bins[:, f], w, width))[:-1]
        p = np.cumsum(np.bincount(bins[:, f], w * y, width))[:-1]
        ok = (n > 0) & (n < total)
        if not ok.any():
            continue
        rest, rest_p = total - n, positive - p
        with np.errstate(divide="ignore", invalid="ignore"):
            after = p * (n - p) / n + rest_p * (rest - rest_p) / rest
        gain = np.where(ok, before - after, -1)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), int(f), k)
    return best


class Forest:
    def __init__(self, trees: list[Tree]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 10, least: int = 3, bins: int = 64, seed: int = 7) -> Forest:
        """y is 0 or 1."""
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
        width = max(len(c) for c in cuts) + 1
        weight = np.ones(len(y))
        some = max(1, round(x.shape[1] * 0.5))
        out = []
        for _ in range(trees):
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                number = len(nodes)
                w = weight[rows]
                nodes.append([-1, 0.0, 0, 0, float((w * y[rows]).sum() / w.sum())])
                if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                    return number
                gain, f, k = _best_split(binned[rows], y[rows], w, rng.permutation(x.shape[1])[:some], width)
                if f < 0:
                    return number
                goes_left = binned[rows, f] <= k
                if min(goes_left.sum(), (~goes_left).sum()) < least:
                    return number
                left = grow(rows[goes_left], level + 1)
                right = grow(rows[~goes_left], level + 1)
                nodes[number][:4] = [f, float(cuts[f][k]) if k < len(cuts[f]) else np.inf, left, right]
                return number

            grow(rng.integers(0, len(y), len(y)), 0)
            table = np.array(nodes)
            out.append(Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]))
        return cls(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives over the trees."""
        return np.mean([t.predict(x) for t in self.trees], axis=0)
