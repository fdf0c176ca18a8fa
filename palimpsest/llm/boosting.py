"""Gradient-boosted trees in numpy, with monotonic constraints, flattened for scoring.

Training takes a bounded table on the driver.  A fitted model is five arrays of
nodes, so scoring a batch is one gather per level for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """Nodes of all trees in one row of arrays; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        for part in np.array_split(self.roots, max(1, len(self.roots) // 16)):
            at = np.tile(part, (len(x), 1))
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x)) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, smoothing: float = 2.0, least: int = 12) -> Forest:
    """Logistic boosting on histograms.  monotone: per feature 1 (may only raise), -1 (may only lower) or 0.

    A split that breaks its constraint is not considered, and the middle of the
    two sides bounds what lies below them, so the whole forest is monotone.  With
    one class only, or no rows, the forest has no trees and returns that class.
    """
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.empty((0, x.shape[1]), int)
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(y), base)
    if len(y) == 0 or y.min() == y.max():
        trees = 0

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + smoothing), low, high))
        at = len(nodes)
        nodes.append([0, np.inf, at, at, value * rate])
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], w, size))[:-1] for w in (g[rows], h[rows], None))
                vl = np.clip(-gs / (hs + smoothing), low, high)
                vr = np.clip(-(total_g - gs) / (total_h - hs + smoothing), low, high)
                gain = gs**2 / (hs + smoothing) + (total_g - gs) ** 2 / (total_h - hs + smoothing) - total_g**2 / (total_h + smoothing)
                gain[(ns < least) | (len(rows) - ns < least) | (monotone[j] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
        if best:
            _, j, k, vl, vr = best
            middle = (vl + vr) / 2
            side = binned[rows, j] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[j]), ((low, high), (low, high)))
            left = grow(rows[side], level + 1, *bounds[0], g, h)
            right = grow(rows[~side], level + 1, *bounds[1], g, h)
            nodes[at] = [j, cuts[j][k], left, right, 0.0]
        return at

    def predict(root: int) -> np.ndarray:
        table = np.array(nodes)
        at = np.full(len(y), root)
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), table[at, 0].astype(int)] <= table[at, 1], table[at, 2], table[at, 3]).astype(int)
        return table[at, 4]

    for _ in range(trees):
        p = sigmoid(margin)
        root = grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p))
        roots.append(root)
        margin = margin + predict(root)
    table = np.array(nodes) if nodes else np.empty((0, 5))
    return Forest(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots, np.int64), depth, base)
