"""Gradient-boosted trees with monotonic constraints, and their flat form.

Training is by histograms over quantile bins with logistic loss.  A constraint
of +1 or -1 on a feature lets the score only rise or fall with it: a split in
the wrong direction is not taken, and below a split on such a feature the leaf
values of either side stay on their side of the middle.

``Forest`` has the trees as plain node arrays: feature, threshold, left, right
and value.  Scoring moves all rows of a batch down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(p: float) -> Forest:
    """A forest without trees: the same answer for every row."""
    none = np.empty(0)
    return Forest(none.astype(np.int64), none, none.astype(np.int64), none.astype(np.int64), none, none.astype(np.int64), 0, float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit to labels 0 and 1.  With one class only, or no rows, the forest is constant."""
    if not len(y):
        return constant(0.999)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if len(np.unique(y)) < 2:
        return constant(p)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * leaf(g.sum(), h.sum(), low, high)])
        if not left or len(rows) < 2 * least:
            score[rows] += nodes[me][4]
            return me
        best = (1e-6, -1, -1, 0.0, 0.0)
        whole = g.sum() ** 2 / (h.sum() + l2)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
            gr, hr = g.sum() - gs, h.sum() - hs
            lv, rv = np.clip(-gs / (hs + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - whole
            ok = (ns >= least) & (len(rows) - ns >= least)
            if monotone[f]:
                ok &= (rv - lv) * monotone[f] >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
        _, f, k, lv, rv = best
        if f < 0:
            score[rows] += nodes[me][4]
            return me
        side = binned[rows, f] <= k
        middle = (lv + rv) / 2
        lows, highs = [low, low], [high, high]
        if monotone[f] > 0:
            highs[0], lows[1] = middle, middle
        elif monotone[f] < 0:
            lows[0], highs[1] = middle, middle
        nodes[me][:2] = [f, float(edges[f][k])]
        nodes[me][2] = grow(rows[side], left - 1, lows[0], highs[0])
        nodes[me][3] = grow(rows[~side], left - 1, lows[1], highs[1])
        return me

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(grow(np.arange(len(y)), depth, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True))
    return Forest(*(np.asarray(c, t) for c, t in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)), np.asarray(roots), depth, start)
