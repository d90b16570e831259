"""Small gradient-boosted trees and isotonic calibration on dense features, for bounded training sets."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Binary logistic boosting with histogram trees of fixed depth."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.base, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(self.edges[j], x[:, j], "right") for j in range(d)], 1)
        p0 = min(max((w * y).sum() / w.sum(), 1e-6), 1 - 1e-6)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (p - y), w * p * (1 - p) + 1e-12
            node = np.zeros(n, np.int64)
            splits = []
            for level in range(self.depth):
                width = 1 << level
                best = [(-1, 0)] * width
                gain = np.full(width, 1e-9)
                for j in range(d):
                    at = node * BINS + code[:, j]
                    gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                    cs = np.bincount(at, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    score = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    score[(cs < self.least) | (ct - cs < self.least)] = -1
                    for k in range(width):
                        b = int(score[k].argmax())
                        if score[k, b] > gain[k]:
                            gain[k], best[k] = score[k, b], (j, b)
                splits.append(best)
                go = np.zeros(n, np.int64)
                for k, (j, b) in enumerate(best):
                    if j >= 0:
                        inside = node == k
                        go[inside] = code[inside, j] > b
                node = node * 2 + go
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.model.append((splits, value))
            f += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        code = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, value in self.model:
            node = np.zeros(len(x), np.int64)
            for best in splits:
                j = np.array([s[0] for s in best])[node]
                b = np.array([s[1] for s in best])[node]
                node = node * 2 + ((j >= 0) & (code[rows, j] > b))
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit (pool adjacent violators), to be read by linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, t, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += t
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, t, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [s / t] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)
