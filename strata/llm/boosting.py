"""Gradient-boosted trees with monotonic constraints, flattened into node arrays (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all rows of a tree go down one level per step."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, penalty: float = 1.0) -> Trees:
    """Logistic loss, second-order splits over quantile bins.

    ``signs[f]`` is 1 or -1 where the score may only rise or only fall with
    feature f, else 0. A split on such a feature must order its children's values
    so, and bounds at their middle hold for everything below. With one class or no
    rows the result is a constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    margin = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[f][rows]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gr, hr = total_g - gl, total_h - hl
                left, right = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
                gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (right - left) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, left[k], right[k]))
        if best[1]:
            f, k, left, right = best[1]
            middle = (left + right) / 2
            bounds = [(low, high), (low, high)]
            if signs[f]:
                bounds = [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
            goes = binned[f][rows] <= k
            nodes[me][0], nodes[me][1] = f, float(edges[f][k])
            nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        else:
            margin[rows] += rate * value
        return me

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, dtype=int), depth, base)
