"""Gradient-boosted trees for a logistic loss on a small labelled sample, with calibrated scores. numpy only."""

from __future__ import annotations

import numpy as np


class Trees:
    """``rounds`` trees of ``depth`` levels; each level of a tree has one split for each of its nodes."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
        score = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            nodes = (1 << self.depth) - 1
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    rows = at == node
                    if rows.sum() < 8:
                        continue
                    best = 1e-6
                    xs, gs, hs = x[rows], g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + 1)
                    for f, values in enumerate(cuts):
                        if not len(values):
                            continue
                        left = xs[:, f, None] <= values
                        gl, hl = gs @ left, hs @ left
                        gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
                        gain[(left.sum(0) < self.least) | ((~left).sum(0) < self.least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], f, values[k]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            leaf = at - nodes
            n = 1 << self.depth
            value = np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1) * self.rate
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += value[at - len(feature)]
        return score


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a raw + b))) fits the labels (Platt), by Newton's steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        d, w = target - p, p * (1 - p) + 1e-9
        hessian = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(d * raw).sum(), d.sum()])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of positives is at least ``precision``."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return float(max(0.5, p[order][good[-1]])) if len(good) else 1.1
