"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

Trees are grown level by level on binned features of a bounded sample. All trees of a model
lie side by side in arrays of one shape, so a batch of rows walks them with numpy: one step
per level, rows times trees at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Boosting(NamedTuple):
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    penalty: float = 1.0
    least_weight: float = 2.0


class Trees(NamedTuple):
    """Node ``n`` of a tree has children ``2n + 1`` and ``2n + 2``; leaves are the last level.

    ``feature`` and ``threshold`` have a row per tree and a column per inner node, ``leaf``
    a column per leaf. A row goes left if its value is at most the threshold.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        inner = self.feature.shape[1]
        for low in range(0, len(x), 4096):
            part = x[low : low + 4096]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            rows = np.arange(len(part))[:, None]
            while inner and node.size and node.flat[0] < inner:
                value = part[rows, self.feature[trees, node]]
                node = 2 * node + 1 + (value > self.threshold[trees, node])
            out[low : low + 4096] += self.leaf[trees, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of every feature."""
    shares = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], shares, method="lower")) for f in range(x.shape[1])]


def train(x: np.ndarray, y: np.ndarray, config: Boosting = Boosting()) -> Trees:
    """Fits log odds to labels 0 and 1. With one class only, or no rows, the model is flat."""
    inner, leaves = 2**config.depth - 1, 2**config.depth
    positive = float(y.sum())
    if not 0 < positive < len(y):
        share = (positive + 0.5) / (len(y) + 1.0)
        none = np.zeros((0, inner))
        return Trees(float(np.log(share / (1 - share))), none.astype(int), none, np.zeros((0, leaves)))
    cuts = cuts_of(x, config.bins)
    width = config.bins
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    features = x.shape[1]
    offset = np.arange(features) * width
    base = float(np.log(positive / (len(y) - positive)))
    raw = np.full(len(y), base)
    feature = np.zeros((config.trees, inner), dtype=np.int64)
    threshold = np.full((config.trees, inner), np.inf)
    leaf = np.zeros((config.trees, leaves))
    for tree in range(config.trees):
        chance = 1.0 / (1.0 + np.exp(-raw))
        slope, weight = y - chance, chance * (1 - chance)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(config.depth):
            nodes, begin = 2**level, 2**level - 1
            place = ((node - begin)[:, None] * (features * width) + offset + binned).ravel()
            shape = (nodes, features, width)
            size = nodes * features * width
            g = np.bincount(place, np.repeat(slope, features), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, features), size).reshape(shape).cumsum(axis=2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = (
                g**2 / (h + config.penalty)
                + (total_g - g) ** 2 / (total_h - h + config.penalty)
                - total_g**2 / (total_h + config.penalty)
            )
            gain[(h < config.least_weight) | (total_h - h < config.least_weight)] = 0.0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            chosen, cut = best // width, best % width
            for own in np.flatnonzero(flat[np.arange(nodes), best] > 1e-9):
                feature[tree, begin + own] = chosen[own]
                threshold[tree, begin + own] = cuts[chosen[own]][cut[own]]
            own = node - begin
            right = x[np.arange(len(y)), chosen[own]] > threshold[tree, node]
            node = 2 * node + 1 + right
        slot = node - inner
        g, h = np.bincount(slot, slope, leaves), np.bincount(slot, weight, leaves)
        leaf[tree] = config.rate * g / (h + config.penalty)
        raw += leaf[tree, slot]
    return Trees(base, feature, threshold, leaf)


class Isotonic(NamedTuple):
    """A non-decreasing step function, linear between its knots."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value) if len(self.at) else score


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators: the monotone fit of labels to scores. Tied scores pool first."""
    if not len(score):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, inverse = np.unique(score, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for place, (size, total) in enumerate(zip(n, np.bincount(inverse, y))):
        blocks.append([total, size, at[place], at[place]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, size, _, high = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += size
            blocks[-1][3] = high
    knots = [(edge, total / size) for total, size, low, high in blocks for edge in {low, high}]
    knots.sort()
    return Isotonic(np.array([k[0] for k in knots]), np.array([k[1] for k in knots]))
