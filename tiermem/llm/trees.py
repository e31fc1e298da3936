"""Boosted trees and random forests on small feature tables, in numpy: fitted on the driver from a bounded sample, sent to tasks as a few arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. A row goes left where its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return self.value[at]
            a = at[live]
            at[live] = np.where(x[live, f[live]] <= self.threshold[a], self.left[a], self.right[a])


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, min_weight: float, pick) -> Tree:
    nodes: list[list] = []

    def grow(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, g / (h + 1e-9)])
        best, choice = 1e-9, None
        if left_depth and len(rows) > 1:
            for f in pick(binned.shape[1]):
                n = len(edges[f]) + 1
                if n < 2:
                    continue
                b = binned[rows, f]
                gs, hs = np.cumsum(np.bincount(b, grad[rows], n))[:-1], np.cumsum(np.bincount(b, hess[rows], n))[:-1]
                ok = (hs >= min_weight) & (h - hs >= min_weight)
                gain = np.where(ok, gs**2 / (hs + 1e-9) + (g - gs) ** 2 / (h - hs + 1e-9) - g**2 / (h + 1e-9), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = gain[k], (f, k)
        if choice:
            f, k = choice
            down = binned[rows, f] <= k
            nodes[me][:2] = f, edges[f][k]
            nodes[me][2] = grow(rows[down], left_depth - 1)
            nodes[me][3] = grow(rows[~down], left_depth - 1)
        return me

    grow(np.arange(len(binned)), depth)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)


@dataclass
class Boosted:
    trees: list[Tree]
    rate: float
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.3) -> Boosted:
    """Gradient boosting of log-loss with Newton steps."""
    edges = _edges(x)
    binned, p0 = _binned(x, edges), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted([], rate, float(np.log(p0 / (1 - p0))))
    score = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = _grow(binned, edges, y - p, p * (1 - p) + 1e-6, depth, 1.0, range)
        t.value = np.clip(t.value, -4, 4)
        model.trees.append(t)
        score += rate * t.predict(x)
    return model


@dataclass
class Forest:
    trees: list[Tree]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x))) / len(self.trees)


def forest(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 9, seed: int = 7) -> Forest:
    """Bootstrap rows, a random square root of the features at each node, mean of the leaves' label shares."""
    rng, edges = np.random.default_rng(seed), _edges(x)
    binned, k = _binned(x, edges), max(1, int(np.sqrt(x.shape[1]) + 0.5))
    trees = []
    for _ in range(n_trees):
        weight = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        trees.append(_grow(binned, edges, y * weight, weight, depth, 2.0, lambda n: rng.permutation(n)[:k]))
    return Forest(trees)


def precise_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which held-out rows above it have that precision (and so the most recall); above all scores if there is none."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    good = np.flatnonzero((hit / np.arange(1, len(s) + 1) >= precision) & np.append(s[:-1] > s[1:], True))
    return float(s[good[-1]]) if len(good) else float("inf")
