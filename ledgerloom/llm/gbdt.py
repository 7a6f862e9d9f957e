"""Histogram gradient-boosted trees, flattened into arrays.

Training sees a bounded sample on the driver; features are binned once, and each
level of a tree sums gradients per (node, bin) with one ``bincount`` a feature.
A tree is a complete binary tree in heap order, so scoring is ``depth`` gathers
for all rows of a batch at once, with no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    least_weight: float = 3.0
    least_gain: float = 1e-3


@dataclass
class Forest:
    """``feature``, ``cut`` (go right over it) by tree and inner node; ``leaf`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(label_share: float) -> Forest:
    """A forest without trees, for a sample with one class or none."""
    p = min(max(label_share, 1e-3), 1 - 1e-3)
    return Forest(float(np.log(p / (1 - p))), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for column in x.T]


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, p: Boosting, offered=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree: features, split bins and each row's leaf. ``offered(level, nodes)`` masks features by node."""
    width = max(map(len, edges)) + 1
    inner, row = (1 << p.depth) - 1, np.arange(binned.shape[1])
    feature, split, at = np.zeros(inner, np.int64), np.full(inner, width), np.zeros(binned.shape[1], np.int64)
    for level in range(p.depth):
        first, nodes = (1 << level) - 1, 1 << level
        own, best = at - first, np.full(nodes, p.least_gain)
        allowed = offered(nodes) if offered else np.ones((len(binned), nodes), bool)
        for f, column in enumerate(binned):
            if not len(edges[f]) or not allowed[f].any():
                continue
            slot = own * width + column
            gs = np.bincount(slot, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
            hs = np.bincount(slot, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gs**2 / (hs + p.l2) + (gt - gs) ** 2 / (ht - hs + p.l2) - gt**2 / (ht + p.l2)
            gain[(hs < p.least_weight) | (ht - hs < p.least_weight) | ~np.isfinite(gain)] = -1
            where = gain.argmax(axis=1)
            most = gain[np.arange(nodes), where]
            better = (most > best) & allowed[f]
            best[better] = most[better]
            feature[first : first + nodes][better] = f
            split[first : first + nodes][better] = where[better]
        at = 2 * at + 1 + (binned[feature[at], row] > split[at])
    return feature, split, at - inner


def _binned(x: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    edges = bin_edges(x, bins)
    return edges, np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])


def _cuts(edges: list[np.ndarray], feature: np.ndarray, split: np.ndarray) -> list[float]:
    return [edges[f][s] if s < len(edges[f]) else np.inf for f, s in zip(feature, split, strict=True)]


def _scaled(weight: np.ndarray | None, rows: int) -> np.ndarray:
    """Weights with a mean of 1, so the limits on leaves stay in sampled rows; 1 each if there are none."""
    return np.ones(rows) if weight is None or not rows else weight / weight.mean()


def fit(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting(), weight: np.ndarray | None = None) -> Forest:
    """Logistic loss with second-order leaves; ties between splits go to the first feature and bin.

    ``weight``: how many rows each row stands for; base and leaves follow the weighted shares.
    """
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    edges, binned = _binned(x, p.bins)
    weight = _scaled(weight, len(y))
    base = constant(float((weight * y).mean())).base
    margin = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(p.trees):
        score = 1 / (1 + np.exp(-margin))
        g, h = weight * (score - y), weight * score * (1 - score)
        feature, split, at = _grow(binned, edges, g, h, p)
        leaf = -p.rate * np.bincount(at, g, 1 << p.depth) / (np.bincount(at, h, 1 << p.depth) + p.l2)
        margin += leaf[at]
        features.append(feature)
        cuts.append(_cuts(edges, feature, split))
        leaves.append(leaf)
    return Forest(base, np.array(features), np.array(cuts, float), np.array(leaves))


def fit_random_forest(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 8, bins: int = 64, seed: int = 1) -> Forest:
    """Bagged trees on variance (Gini) splits, each node offered a random third of the features.

    ``margin`` of the result is the mean share of label 1 over the leaves.
    """
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Forest(share, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    rng = np.random.default_rng(seed)
    edges, binned = _binned(x, bins)
    p = Boosting(depth=depth, l2=0.0, least_weight=2.0, least_gain=1e-9)
    offer = max(2, x.shape[1] // 3)

    def offered(nodes: int) -> np.ndarray:
        return rng.random((x.shape[1], nodes)).argsort(axis=0) < offer

    features, cuts, leaves = [], [], []
    for _ in range(trees):
        weight = rng.poisson(1.0, len(y)).astype(float)
        feature, split, at = _grow(binned, edges, -weight * y, weight, p, offered)
        hits, total = np.bincount(at, weight * y, 1 << depth), np.bincount(at, weight, 1 << depth)
        features.append(feature)
        cuts.append(_cuts(edges, feature, split))
        leaves.append(np.where(total > 0, hits / np.maximum(total, 1e-9), share) / trees)
    return Forest(0.0, np.array(features), np.array(cuts, float), np.array(leaves))


@dataclass
class Isotonic:
    """A non-decreasing map from scores to shares of label 1 (pool adjacent violators)."""

    knots: np.ndarray
    values: np.ndarray

    @staticmethod
    def fit(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        if not len(y) or y.min() == y.max():
            return Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        weight = _scaled(weight, len(y))
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, least and largest score
        for s, label, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([w * label, w, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1][0] += last[0]
                blocks[-1][1] += last[1]
                blocks[-1][3] = last[3]
        value = [(b[0] + 0.5 * float((weight * y).mean())) / (b[1] + 0.5) for b in blocks]
        value = np.maximum.accumulate(value)
        return Isotonic(np.array([k for b in blocks for k in (b[2], b[3])]), np.repeat(value, 2))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.values)
