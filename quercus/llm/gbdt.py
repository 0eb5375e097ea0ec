"""Small gradient-boosted trees for binary labels: histogram splits, logistic loss, numpy only."""

from __future__ import annotations

import numpy as np


class Trees:
    """Fit on a bounded sample on the driver; the fitted arrays are small and go to the executors."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._of(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree of feature, bin and leaf value; a node that isn't split sends all rows to the left."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(b), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at):
                best = (1e-6, 0, self.bins)
                G, H = g[at].sum(), h[at].sum()
                for j in range(b.shape[1]):
                    sg, sh = (np.cumsum(np.bincount(b[at, j], w, self.bins))[:-1] for w in (g[at], h[at]))
                    ok = (sh >= self.least) & (H - sh >= self.least)
                    gain = np.where(ok, sg**2 / (sh + 1) + (G - sg) ** 2 / (H - sh + 1) - G**2 / (H + 1), 0)
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (gain[c], j, c)
                feature[k], cut[k] = best[1:]
                node[at] = 2 * k + 1 + (b[at, feature[k]] > cut[k])
        leaf = node - inner
        n = 1 << self.depth
        value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
        return feature, cut, value

    def _of(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - ((1 << self.depth) - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f = self.base + sum((self._of(t, b) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))
