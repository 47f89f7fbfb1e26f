"""Gradient-boosted trees for a yes-no label, on binned features, small enough to train in the driver and to ship to tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """``cuts``: bin borders of each feature; ``trees``: complete binary trees as (feature, bin, leaf values)."""

    base: float
    cuts: list[np.ndarray]
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        b = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1).astype(np.int16) if len(x) else np.empty((0, len(self.cuts)), np.int16)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, border, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > border[at])
            out += leaf[at - (1 << self.depth) + 1]
        return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 2.0, share: float = 0.4, seed: int = 5) -> Boosted:
    """Second-order boosting of the logistic loss; every level of a tree is split at once from histograms of a ``share`` of the rows."""
    odds = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    model = Boosted(float(np.log(odds / (1 - odds))), cuts, depth)
    b = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    n, f = b.shape
    width = bins + 1
    margin, rng = np.full(n, model.base), np.random.default_rng(seed)
    flat = np.arange(f) * width + b
    for _ in range(rounds):
        some = np.flatnonzero(rng.random(n) < share) if n > 1000 else np.arange(n)
        p = 1 / (1 + np.exp(-margin[some]))
        g, h = y[some] - p, np.maximum(p * (1 - p), 1e-9)
        wide_g, wide_h, own = np.repeat(g, f), np.repeat(h, f), flat[some]
        feature, border = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            cell = (((at[some] - first) * f * width)[:, None] + own).ravel()
            left = np.stack([np.bincount(cell, v, nodes * f * width).reshape(nodes, f, width) for v in (wide_g, wide_h)]).cumsum(axis=3)
            total = left[:, :, :, -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[1] < least) | (right[1] < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            feature[first : first + nodes] = np.where(good, best // width, 0)
            border[first : first + nodes] = np.where(good, best % width, width)
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > border[at])
        leaf = at - (1 << depth) + 1
        value = rate * np.bincount(leaf[some], g, 1 << depth) / (np.bincount(leaf[some], h, 1 << depth) + ridge)
        model.trees.append((feature, border, value))
        margin += value[leaf]
    return model
