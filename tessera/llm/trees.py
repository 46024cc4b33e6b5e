"""Bagged decision trees in numpy, small enough to fit on the driver from a bounded sample and to send to every worker."""

from __future__ import annotations

import numpy as np


class Tree:
    """One classification tree as flat arrays; leaf values are the share of positive rows."""

    def __init__(self, depth: int, least: int):
        self.depth, self.least = depth, least
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.child: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tried: int) -> Tree:
        self._grow(x, y, np.arange(len(y)), 0, rng, tried)
        return self

    def _grow(self, x, y, rows, depth, rng, tried) -> int:
        me = len(self.feature)
        p = y[rows].mean() if len(rows) else 0.0
        self.feature.append(-1), self.cut.append(0.0), self.child.append(0), self.value.append(float(p))
        if depth == self.depth or len(rows) < 2 * self.least or p in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], min(tried, x.shape[1]), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(rows) + 1)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= self.least) & (n[:-1] <= len(rows) - self.least))
            if not len(ok):
                continue
            l, a = n[ok], t[ok]
            r, b = len(rows) - l, t[-1] - a
            gain = p * (1 - p) - (a * (1 - a / l) + b * (1 - b / r)) / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return me
        left = x[rows, best[1]] <= best[2]
        self.feature[me], self.cut[me] = best[1], best[2]
        self._grow(x, y, rows[left], depth + 1, rng, tried)
        self.child[me] = len(self.feature)
        self._grow(x, y, rows[~left], depth + 1, rng, tried)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, child, value = map(np.array, (self.feature, self.cut, self.child, self.value))
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, np.where(right, child[at], at + 1), at)
        return value[at]


def fit_bag(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 3, seed: int = 7) -> list[Tree]:
    """Each tree sees a bootstrap sample of the rows, every split half of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(Tree(depth, least).fit(x[rows], y[rows], rng, max(1, x.shape[1] // 2)))
    return out


def vote(bag: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(x) for t in bag], axis=0) if len(x) else np.zeros(0)
