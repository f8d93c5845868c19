"""Histogram boosting on binned rows, which may stand for many rows each: shared by the quality model and the span classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LAMBDA = 1.0
MIN_ROWS = 8
BINS = 32


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 increasing cut points: midpoints if there are few values, else quantiles."""
    seen = np.unique(values[np.isfinite(values)])
    if len(seen) <= 1:
        return np.zeros(0)
    if len(seen) <= bins:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def counted_edges(seen: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """`bin_edges` of a column in which the increasing values `seen` come `n` times each."""
    if len(seen) <= bins:
        return bin_edges(seen, bins)
    behind = np.cumsum(n)
    place = np.linspace(0, 1, bins + 1)[1:-1] * (behind[-1] - 1)
    low, high = (seen[np.searchsorted(behind, at, side="right")] for at in (np.floor(place), np.ceil(place)))
    return np.unique(low + (high - low) * (place - np.floor(place)))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, f], side="right") for f, e in enumerate(edges)], axis=1).astype(np.int16)


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; bins up to the place go left."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, -1
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
    gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = 0.0
    at = int(gain.argmax())
    return float(gain[at]), at if gain[at] > 1e-9 else -1


def shape_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree on one feature, written out as a value per bin."""
    _, at = best_cut(g, h, n) if depth else (0.0, -1)
    if at < 0:
        return np.full(len(g), -g.sum() / (h.sum() + LAMBDA))
    left, right = slice(0, at + 1), slice(at + 1, len(g))
    return np.concatenate([shape_tree(g[left], h[left], n[left], depth - 1), shape_tree(g[right], h[right], n[right], depth - 1)])


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i+1 and 2i+2; feature -1 always goes left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            f = self.feature[node]
            right = (f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[node])
            node = 2 * node + 1 + right
        return self.leaf[node - len(self.feature)]


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, sizes: list[int]) -> Tree:
    """`g`, `h` and `n`: the sums of the gradients and the number of the rows that each row of `bins` stands for."""
    inner = 2**depth - 1
    tree = Tree(np.full(inner, -1, np.int64), np.zeros(inner, np.int64), np.zeros(inner + 1))
    rows = {0: np.arange(len(g))}
    for i in range(inner):
        own = rows.pop(i)
        best = (0.0, -1, -1)
        for f, size in enumerate(sizes):
            if size > 1 and n[own].sum() >= 2 * MIN_ROWS:
                b = bins[own, f]
                gain, at = best_cut(*(np.bincount(b, weights=w, minlength=size) for w in (g[own], h[own], n[own])))
                if at >= 0 and gain > best[0]:
                    best = (gain, f, at)
        right = np.zeros(len(own), bool)
        if best[1] >= 0:
            tree.feature[i], tree.cut[i] = best[1], best[2]
            right = bins[own, best[1]] > best[2]
        rows[2 * i + 1], rows[2 * i + 2] = own[~right], own[right]
    for leaf in range(inner + 1):
        own = rows[inner + leaf]
        tree.leaf[leaf] = -g[own].sum() / (h[own].sum() + LAMBDA) if len(own) else 0.0
    return tree


@dataclass
class Boosted:
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    rate: float

    def margin(self, values: np.ndarray) -> np.ndarray:
        return self.margin_of_bins(binned(values, self.edges))

    def margin_of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))


def boost(values: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = BINS) -> Boosted:
    """Gradient boosted trees for the log loss (second-order steps)."""
    edges = [bin_edges(values[:, f], bins) for f in range(values.shape[1])]
    return boost_counted(binned(values, edges), y, np.ones(len(y)), edges, rounds, depth, rate)


def boost_counted(
    b: np.ndarray, y: np.ndarray, n: np.ndarray, edges: list[np.ndarray], rounds: int = 60, depth: int = 4, rate: float = 0.2
) -> Boosted:
    """The same for binned rows that come `n` times each."""
    sizes = [len(e) + 1 for e in edges]
    p = np.clip((y * n).sum() / n.sum(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(p / (1 - p))), [], rate)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = sigmoid(margin)
        tree = grow(b, (q - y) * n, q * (1 - q) * n, n, depth, sizes)
        model.trees.append(tree)
        margin += rate * tree.predict(b)
    return model


def isotonic(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing scores and the calibrated probability from each of them on; a row comes `n` times."""
    order = np.argsort(score, kind="stable")
    n = np.ones(len(y)) if n is None else n
    blocks: list[list[float]] = []  # first score, sum of y, rows
    for s, t, rows in zip(score[order], y[order], n[order], strict=True):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += t * rows
            blocks[-1][2] += rows
        else:
            blocks.append([float(s), float(t * rows), float(rows)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    at, p = steps
    if not len(at):
        return sigmoid(score)
    return p[np.clip(np.searchsorted(at, score, side="right") - 1, 0, len(p) - 1)]
