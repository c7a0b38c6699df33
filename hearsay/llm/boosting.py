"""Gradient-boosted trees for two classes over a bounded training set, evaluated on whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: a row goes right where its feature exceeds the cut."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.values.shape[1]))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (len(value) - 1)]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, pace: float = 0.15,
    calm: float = 5.0, least: float = 8.0, drawn: float = 0.5, seed: int = 1,
) -> Trees:
    """Newton boosting of the logistic loss on binned features; splits need ``least`` weight on either side.

    Splits are chosen on a share ``drawn`` of the rows, other ones for each tree.
    """
    rng = np.random.default_rng(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = ([], [], [])
    flat = binned + np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.where(rng.random(n) < drawn, 0, -1)
        for level in range(depth):
            first = (1 << level) - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                cells = flat[rows].ravel()
                g, h, w = (
                    np.bincount(cells, np.repeat(v[rows], width), width * BINS).reshape(width, BINS)
                    for v in (slope, curve, weight)
                )
                left = [np.cumsum(v, axis=1)[:, :-1] for v in (g, h, w)]
                whole = [v[0].sum() for v in (g, h, w)]
                gain = left[0] ** 2 / (left[1] + calm) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + calm)
                gain -= whole[0] ** 2 / (whole[1] + calm)
                gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
                best = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[best] > 1e-6 and best[1] < len(edges[best[0]]):
                    feature[node], cut[node] = best[0], edges[best[0]][best[1]]
            at = np.where(at < 0, -1, 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at]))
        leaf = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            leaf = 2 * leaf + 1 + (x[np.arange(n), feature[leaf]] > cut[leaf])
        leaf -= inner
        value = pace * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + calm)
        score += value[leaf]
        for column, v in zip(out, (feature, cut, value), strict=True):
            column.append(v)
    return Trees(*(np.array(c) for c in out), base)
