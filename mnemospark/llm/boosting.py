"""Gradient boosted trees for a bounded sample, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Booster:
    """Trees of a fixed depth over binned features; a tree is its split features, split values and leaf values by level."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, value, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > value[at])
            out += leaf[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.shift, -30, 30)))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree, level by level: the histograms of all nodes of a level are made together."""
    inner = 2**depth - 1
    feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        here = at - first
        best = np.full(nodes, 1e-6)
        gt, ht = np.bincount(here, g, nodes)[:, None], np.bincount(here, h, nodes)[:, None]
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            width = len(c) + 1
            key = here * width + binned[:, f]
            gl = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
            hl = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            k = gain.argmax(axis=1)
            top = gain[np.arange(nodes), k]
            better = np.flatnonzero(top > best)
            best[better], feature[first + better], value[first + better] = top[better], f, c[k[better]]
        at = 2 * at + 1 + (x[rows, feature[at]] > value[at])
    gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
    return feature, value, rate * gs / (hs + 1)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 24, seed: int = 0) -> Booster:
    """Logistic boosting on the rows that aren't held out; those calibrate the scores (a logistic of the score) and the threshold (the best F1).

    Without `held` a fifth is held out by chance. Where all labels are equal the score is
    the smoothed share of the label; any other number of rows is fitted.
    """
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2 if held is None else held
    if not len(y):
        return Booster(-30.0, [])
    if (~held).sum() < 2 or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    xt, yt = x[~held], y[~held].astype(float)
    p = (yt.sum() + 0.5) / (len(yt) + 1)
    model = Booster(float(np.log(p / (1 - p))), [])
    if yt.min() == yt.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(xt[:, f])
        cuts.append((v[:-1] + v[1:]) / 2 if len(v) <= bins else np.unique(np.quantile(xt[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(c, xt[:, f]) for f, c in enumerate(cuts)], axis=1)
    s = np.full(len(yt), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-s))
        tree = _grow(xt, cuts, binned, yt - q, q * (1 - q), depth, rate)
        model.trees.append(tree)
        s += Booster(0.0, [tree]).score(xt)
    z, t = model.score(x[held]), y[held].astype(float)
    if len(t) and t.min() != t.max():
        a, b = 1.0, 0.0
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a += 0.5 * ((t - q) * z).mean() / max(1.0, (z**2).mean())
            b += 0.5 * (t - q).mean()
        model.slope, model.shift = max(a, 0.05), b
        q = model.probability(x[held])
        grid = np.linspace(0.05, 0.95, 37)
        f1 = [2 * ((q >= c) & (t > 0)).sum() / max(1, (q >= c).sum() + (t > 0).sum()) for c in grid]
        top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        model.threshold = float(grid[top[len(top) // 2]])
    return model


@dataclass
class Forest:
    """One booster for each part of the rows, fitted on the others; their mean probability."""

    parts: list[Booster]
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.mean([b.probability(x) for b in self.parts], axis=0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, part: np.ndarray, seed: int = 0) -> Forest:
        """The threshold is that of the best F1 over all rows, each scored by the booster that hasn't seen it."""
        parts, p = [], np.zeros(len(y))
        for k in np.unique(part):
            parts.append(fit(x, y, held=part == k, seed=seed))
            p[part == k] = parts[-1].probability(x[part == k])
        if not len(y):
            return cls([fit(x, y)], 0.5)
        grid = np.linspace(0.05, 0.95, 37)
        f1 = np.array([2 * ((p >= c) & (y > 0)).sum() / max(1, (p >= c).sum() + (y > 0).sum()) for c in grid])
        top = np.flatnonzero(f1 >= f1.max() - 0.001)
        return cls(parts, float(grid[top[len(top) // 2]]))
