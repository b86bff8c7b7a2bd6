"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Trees:
    """`n` complete binary trees of one depth, node k's children at 2k+1 and 2k+2.

    feature, threshold: n x (2^depth - 1), a row goes right if its value is above the threshold; leaf: n x 2^depth.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x: all rows go down all trees together, one level at a time."""
        n, trees = len(x), len(self.feature)
        if not trees or not n:
            return np.full(n, self.base)
        node = np.zeros((n, trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending cut points of each feature, midway between neighbouring quantiles."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
        cuts.append((values[:-1] + values[1:]) / 2)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosts logistic loss with Newton leaves. Split gains come from gradient histograms over at most `bins` bins a feature.

    No rows or one class only: a model of no trees that answers with the prior (0.5 for no rows). Ties go to the first feature and cut.
    """
    n, features = x.shape
    prior = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(prior / (1 - prior)))
    none = Trees(base, depth, np.zeros((0, 2**depth - 1), np.int32), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if n == 0 or y.min() == y.max():
        return none
    cuts = _edges(x, bins)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    cell = binned + np.arange(features) * bins
    valid = np.zeros((features, bins), bool)
    for k, c in enumerate(cuts):
        valid[k, : len(c)] = True
    out_f, out_t, out_l = [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        p = _sigmoid(score)
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (features * bins) + cell).ravel()
            size = width * features * bins
            hg = np.bincount(at, np.repeat(g, features), size).reshape(width, features, bins).cumsum(axis=2)
            hh = np.bincount(at, np.repeat(h, features), size).reshape(width, features, bins).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[~np.broadcast_to(valid, gain.shape) | (hh < least) | (th - hh < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            first = width - 1
            feature[first : first + width] = np.where(split, f, 0)
            threshold[first : first + width] = [cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, split, strict=True)]
            right = split[node] & (binned[np.arange(n), f[node]] > b[node])
            node = 2 * node + right
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        score += leaf[node]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Trees(base, depth, np.array(out_f), np.array(out_t), np.array(out_l))


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing piecewise linear map of scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y) if len(self.x) else scores


def isotonic(scores: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators, then keeps each block's mean score and mean label. Equal scores are one block; no rows: the identity."""
    if not len(scores):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, inverse = np.unique(scores, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, w, t in zip(at, weight, total, strict=True):
        blocks.append([w, t, s * w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w1, t1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w1, blocks[-1][1] + t1, blocks[-1][2] + s1]
    b = np.array(blocks)
    return Isotonic(b[:, 2] / b[:, 0], b[:, 1] / b[:, 0])
