"""Boosted regression trees on binned features, one small model per group.

Squared error, shrinkage, row and column sampling per tree, and a penalty on leaf
weights. A missing value has no bin: every split learns on which side missing
values do better, so nothing is imputed. Splits are searched in histograms of
gradients, for all leaves, features and sides of a level at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Most bins of a feature; the penalty on leaf weights; the fewest rows of a leaf; the least gain of a split.
MAX_BINS, PENALTY, LEAST_ROWS, LEAST_GAIN = 256, 1.0, 1.0, 1e-6


@dataclass(frozen=True)
class Trees:
    """All trees of a model: full binary trees by level, one row each. A leaf above the last level sends every row left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        place = np.zeros((len(x), len(self.feature)), np.int64)
        depth = int(np.log2(self.feature.shape[1] + 1))
        for _ in range(depth):
            value = x[rows, self.feature[trees, place]]
            left = np.where(np.isnan(value), self.missing_left[trees, place], value < self.threshold[trees, place])
            place = 2 * place + 2 - left
        return self.base + self.weight[trees, place - self.feature.shape[1]].sum(axis=1)


def thresholds(x: np.ndarray, most: int = MAX_BINS) -> np.ndarray:
    """Ascending limits between bins: midpoints of neighbouring values, or of their quantiles if there are too many."""
    values = np.unique(x[~np.isnan(x)])
    if len(values) > most:
        values = np.unique(np.quantile(values, np.linspace(0, 1, most)))
    return (values[1:] + values[:-1]) / 2


def best_splits(gradient: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per leaf the gain, feature, last bin on the left and side of the missing values of its best split.

    `gradient` and `count` are sums by (leaf, feature, bin); the last bin holds the missing values. Of equal
    gains the first feature, bin and missing values on the right win.
    """
    left = [np.stack([s[..., :-1].cumsum(axis=2), s[..., :-1].cumsum(axis=2) + s[..., -1:]], axis=3) for s in (gradient, count)]
    whole = [s.sum(axis=2)[..., None, None] for s in (gradient, count)]
    right = [w - p for w, p in zip(whole, left)]
    quality = lambda g, n: g * g / (n + PENALTY)
    gain = 0.5 * (quality(*left) + quality(*right) - quality(*whole))
    gain = np.where((left[1] >= LEAST_ROWS) & (right[1] >= LEAST_ROWS), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    most = flat.max(axis=1)
    best = (flat >= (most - 1e-12 * np.maximum(1.0, np.abs(most)))[:, None]).argmax(axis=1)
    feature, bin_, side = np.unravel_index(best, gain.shape[1:])
    return flat[np.arange(len(flat)), best], feature, bin_, side == 1


def fit(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, rows: float, columns: float, seed) -> Trees:
    """Boosted trees of `depth` levels; `rows` and `columns` are the shares that each tree sees. NaN is missing."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    limits = [thresholds(c) for c in x.T]
    bins = max(2, 1 + max((len(t) for t in limits), default=0))
    binned = np.column_stack([np.where(np.isnan(c), bins, np.searchsorted(t, c, "right")) for c, t in zip(x.T, limits)])
    table = np.full((width, bins), np.inf)  # the limit above each bin; nothing is above the last
    for f, t in enumerate(limits):
        table[f, : len(t)] = t
    seen = max(1, int(columns * width))
    inner = 2**depth - 1
    feature, threshold = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    missing_left, weight = np.ones((rounds, inner), bool), np.zeros((rounds, 2**depth))
    base = float(y.mean())
    error = base - y
    cell = np.arange(width) * (bins + 1)
    for k in range(rounds):
        used = np.flatnonzero(rng.random(n) < rows) if rows < 1 else np.arange(n)
        hidden = rng.permutation(width)[seen:]
        place = np.zeros(n, np.int64)  # in the level
        open_ = np.ones(1, bool)
        for level in range(depth):
            leaves, first = 2**level, 2**level - 1
            at = (place[used, None] * (width * (bins + 1)) + cell + binned[used]).ravel()
            shape = (leaves, width, bins + 1)
            gradient = np.bincount(at, np.repeat(error[used], width), minlength=np.prod(shape)).reshape(shape)
            count = np.bincount(at, minlength=np.prod(shape)).reshape(shape).astype(float)
            count[:, hidden] = 0.0  # no rows on either side, so never split
            gain, f, b, side = best_splits(gradient, count)
            open_ = open_ & (gain > LEAST_GAIN)
            nodes = first + np.flatnonzero(open_)
            feature[k, nodes], threshold[k, nodes], missing_left[k, nodes] = f[open_], table[f, b][open_], side[open_]
            value = binned[np.arange(n), f[place]]
            goes_left = np.where(value == bins, side[place], value <= b[place]) | ~open_[place]
            place = 2 * place + 1 - goes_left
            open_ = np.repeat(open_, 2)
        total, number = np.bincount(place[used], error[used], minlength=2**depth), np.bincount(place[used], minlength=2**depth)
        weight[k] = -rate * total / (number + PENALTY)
        error += weight[k, place]
    return Trees(base, feature, threshold, missing_left, weight)
