"""Gradient-boosted trees for a yes/no label over a dense matrix, with isotonic calibration.

Small and self-contained: quantile-binned features, second-order logistic
boosting, pool-adjacent-violators. It is fitted on a bounded sample only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, c, left, right, v = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if not len(inner):
                return v[at]
            n = at[inner]
            at[inner] = np.where(x[inner, f[n]] <= c[n], left[n], right[n])


@dataclass
class Boosted:
    """score() is a calibrated probability, in order with the raw margin."""

    base: float = 0.0
    rate: float = 0.2
    trees: list[Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        p = self.raw(x)
        # A thousandth of the raw score keeps the order within a flat step.
        return np.clip(0.999 * np.interp(p, self.knots, self.levels) + 0.001 * p, 0, 1)


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float) -> Tree:
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        at = tree.add()
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.value[at] = -gs / (hs + 1.0)
        if level == depth or len(rows) < 2:
            return at
        best, where = 1e-6, None
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < least) | (hs - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (j, k)
        if where:
            j, k = where
            low = bins[rows, j] <= k
            tree.feature[at], tree.cut[at] = j, float(edges[j][k])
            tree.left[at] = node(rows[low], level + 1)
            tree.right[at] = node(rows[~low], level + 1)
        return at

    node(np.arange(len(g)), 0)
    return tree


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising step fit of y on p (pool adjacent violators)."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # mean of y, weight, mean of p
    for a, b in zip(p[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            n, v, d = blocks[-1]
            blocks[-1] = [(m * w + n * v) / (w + v), w + v, (c * w + d * v) / (w + v)]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 48) -> Boosted:
    """Trees on the rows that are not held, calibration on those that are."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.0 if len(y) == 0 else float(y.mean())
        return Boosted(base=float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    if y[~hold].sum() in (0, (~hold).sum()) or y[hold].sum() in (0, hold.sum()):
        hold = np.zeros(len(y), bool)
    tx, ty = x[~hold], y[~hold].astype(float)
    edges = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, n_bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    edges = [e[e < tx[:, j].max()] for j, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, tx[:, j], side="left") for j, e in enumerate(edges)], 1)
    prior = ty.mean()
    model = Boosted(base=float(np.log(prior / (1 - prior))), rate=rate)
    z = np.full(len(ty), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        if np.abs(p - ty).max() < 0.01:
            break
        tree = _grow(bins, edges, p - ty, p * (1 - p), depth, least=0.5)
        model.trees.append(tree)
        z += rate * tree.predict(tx)
    if hold.any():
        model.knots, model.levels = isotonic(model.raw(x[hold]), y[hold].astype(float))
    return model
