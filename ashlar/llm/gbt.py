"""Gradient-boosted trees in numpy: histogram training, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays; a leaf has feature -1.  Scores are log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees descend together, a level at a time."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, sign: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf: float = 5.0, l2: float = 1.0) -> Forest:
    """Logistic boosting.  sign[f]: +1 the score may only rise with feature f, -1 only fall, 0 free.

    Constraints hold for the whole forest: a split is refused if its leaves are in the wrong order, and each side
    is bounded by the midpoint, so deeper leaves cannot cross it.
    """
    n, m = x.shape if x.ndim == 2 else (0, len(sign))
    p = min(max(y.mean(), 1e-4), 1 - 1e-4) if n else 0.5
    base = float(np.log(p / (1 - p))) if n else 0.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # code <= j means x <= cuts[j]
        score = np.full(n, base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            G, H = g[rows].sum(), h[rows].sum()
            me = len(nodes)
            nodes.append([-1, 0.0, me, me, rate * float(np.clip(-G / (H + l2), low, high))])
            if level == depth or H < 2 * leaf * 0.05 or len(rows) < 2 * leaf:
                return me
            best = (1e-6, -1, 0, 0.0, 0.0)
            for f in range(m):
                k = len(cuts[f])
                if not k:
                    continue
                c = code[rows, f]
                gl = np.bincount(c, g[rows], k + 1).cumsum()[:k]
                hl = np.bincount(c, h[rows], k + 1).cumsum()[:k]
                nl = np.bincount(c, minlength=k + 1).cumsum()[:k]
                wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(G - gl) / (H - hl + l2), low, high)
                gain = -(gl * wl + 0.5 * (hl + l2) * wl**2 + (G - gl) * wr + 0.5 * (H - hl + l2) * wr**2)
                w = np.clip(-G / (H + l2), low, high)
                gain += G * w + 0.5 * (H + l2) * w**2
                bad = (nl < leaf) | (len(rows) - nl < leaf)
                if sign[f]:
                    bad |= sign[f] * (wr - wl) < 0
                gain[bad] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), f, j, float(wl[j]), float(wr[j]))
            _, f, j, wl, wr = best
            if f < 0:
                return me
            go = code[rows, f] <= j
            mid = (wl + wr) / 2
            bounds = [(low, high), (low, high)]
            if sign[f] > 0:
                bounds = [(low, mid), (mid, high)]
            elif sign[f] < 0:
                bounds = [(mid, high), (low, mid)]
            a = grow(rows[go], g, h, level + 1, *bounds[0])
            b = grow(rows[~go], g, h, level + 1, *bounds[1])
            nodes[me][:4] = [f, float(cuts[f][j]), a, b]
            return me

        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(n), q - y, np.maximum(q * (1 - q), 1e-6), 0, -8.0, 8.0))
            one = _pack(nodes, roots[-1:], 0.0, depth)
            score += one.raw(x)
    return _pack(nodes, roots, base, depth)


def _pack(nodes: list[list[float]], roots: list[int], base: float, depth: int) -> Forest:
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), base, depth)
