"""A random forest of binned classification trees, in numpy, for small training tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Trees as arrays [tree, node]: a node's feature (-1: leaf), its cut, and its share of label 1.
    Children of node i are 2i + 1 (value <= cut) and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees' leaves."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += value[node]
        return total / len(self.feature)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 11) -> Forest:
    """Bootstrap rows per tree and a random square root of the features per node; Gini splits on quantile bins."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    nodes = 2 ** (depth + 1) - 1
    out = Forest(np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.float32), np.zeros((trees, nodes), np.float32))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f].astype(np.float32), "left") for f, c in enumerate(cuts)], axis=1)
    tries = max(1, round(width**0.5))
    for t in range(trees):
        wait = [(0, rng.integers(0, n, n), 0)]
        while wait:
            node, rows, level = wait.pop()
            ones = y[rows].sum()
            out.value[t, node] = (ones + 0.5) / (len(rows) + 1)
            if level == depth or len(rows) < 2 * least or ones in (0, len(rows)):
                continue
            best = None
            for f in rng.choice(width, tries, replace=False):
                b = binned[rows, f]
                count = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
                hit = np.cumsum(np.bincount(b, y[rows], minlength=BINS + 1))[:-1]
                left, right = count, len(rows) - count
                ok = (left >= least) & (right >= least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    purity = np.where(ok, hit**2 / left + (left - hit) ** 2 / left + (ones - hit) ** 2 / right + (right - ones + hit) ** 2 / right, -1)
                at = int(np.argmax(purity))
                if best is None or purity[at] > best[0]:
                    best = (purity[at], f, at)
            if best is None:
                continue
            _, f, at = best
            out.feature[t, node], out.cut[t, node] = f, cuts[f][min(at, len(cuts[f]) - 1)]
            go = binned[rows, f] > at
            wait += [(2 * node + 1, rows[~go], level + 1), (2 * node + 2, rows[go], level + 1)]
    return out
