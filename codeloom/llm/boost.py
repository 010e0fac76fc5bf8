"""Gradient boosted trees for two classes, in numpy: small models, fitted on the driver, applied to Arrow batches."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic loss, depth-limited trees on binned features, then Platt scaling on rows held out from the trees."""

    def __init__(self, n_trees: int = 80, depth: int = 4, rate: float = 0.2, least: int = 8, penalty: float = 1.0):
        self.n_trees, self.depth, self.rate, self.least, self.penalty = n_trees, depth, rate, least, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, xh: np.ndarray, yh: np.ndarray) -> Boosted:
        """Trees on (x, y); calibration on the rows held out (xh, yh)."""
        yt = y.astype(float)
        p = min(max(yt.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(yt), self.base)
        x = x.astype(np.float32)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(c)) > BINS else (np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
        used = [f for f, c in enumerate(cuts) if len(c)]
        # a bin of every value, numbered through over all features, so that one count serves them all
        bins = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") + k * BINS for k, f in enumerate(used)], axis=1).astype(np.int32)
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, used, yt - q, q * (1 - q), cuts)
            self.trees.append(tree)
            score += self._apply(tree, x)
        raw, held = self.raw(xh), yh.astype(float)
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps with a ridge towards the raw scores
            q = 1 / (1 + np.exp(-(a * raw + b)))
            w = q * (1 - q) + 1e-6
            g = np.array([((q - held) * raw).sum() + (a - 1), (q - held).sum()])
            h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(b)
        return self

    def _grow(self, bins: np.ndarray, used: list[int], g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, wide = 2 ** (self.depth + 1) - 1, bins.shape[1]
        feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.float32), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            at = rows.pop(node, None)
            if at is None or not len(at):
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[node] = self.rate * gs / (hs + self.penalty)
            if node >= size // 2 or len(at) < 2 * self.least:
                continue
            flat = bins[at].ravel()
            gl, hl, n = (np.bincount(flat, w, wide * BINS).reshape(wide, BINS).cumsum(axis=1) for w in (np.repeat(g[at], wide), np.repeat(h[at], wide), None))
            gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs * gs / (hs + self.penalty)
            gain[(n < self.least) | (len(at) - n < self.least)] = -1
            k, c = divmod(int(gain.argmax()), BINS)
            if gain[k, c] > 1e-6 and c < len(cuts[used[k]]):
                feature[node], cut[node] = used[k], cuts[used[k]][c]
                left = bins[at, k] <= c + k * BINS
                rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, every = np.zeros(len(x), np.int32), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f < 0, node, np.where(x[every, np.maximum(f, 0)] <= cut[node], 2 * node + 1, 2 * node + 2))
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))
