"""Gradient-boosted depth-two trees for a few thousand rows, and their form as SQL columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Forest:
    """Trees as (feature, cut, left, right) with leaves as numbers, a first score, and the slope and
    shift of the calibration."""

    trees: tuple
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def _cuts(x: np.ndarray, most: int = 16) -> list[np.ndarray]:
    found = []
    for column in x.T:
        v = np.unique(column)
        mid = (v[1:] + v[:-1]) / 2
        found.append(mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most))))
    return found


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> float:
    return float(rate * g.sum() / (h.sum() + 1.0))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]):
    best, total = None, g.sum() ** 2 / (h.sum() + 1.0)
    for f, cs in enumerate(cuts):
        if not len(cs):
            continue
        left = x[:, f][:, None] <= cs
        gl, hl = g @ left, h @ left
        gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total
        i = int(np.argmax(gain))
        if best is None or gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float(cs[i]))
    return best


def _grow(x, g, h, cuts, depth: int, rate: float):
    found = _split(x, g, h, cuts) if depth and len(g) > 1 else None
    if found is None or found[0] < 1e-6:
        return _leaf(g, h, rate)
    _, f, c = found
    left = x[:, f] <= c
    return (f, c, _grow(x[left], g[left], h[left], cuts, depth - 1, rate), _grow(x[~left], g[~left], h[~left], cuts, depth - 1, rate))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, a, b = tree
    return np.where(x[:, f] <= c, _apply(a, x), _apply(b, x))


def raw(forest: Forest, x: np.ndarray) -> np.ndarray:
    return forest.bias + sum((_apply(t, x) for t in forest.trees), np.zeros(len(x)))


def predict(forest: Forest, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(forest.slope * raw(forest, x) + forest.shift)))


def set_aside(n: int) -> np.ndarray:
    """Which of ``n`` rows serve calibration only."""
    return np.arange(n) % 5 == 4


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 2) -> Forest:
    """Boost on four fifths of the rows and calibrate the score (Platt's curve) on the others."""
    aside = set_aside(len(y))
    xt, yt = x[~aside], y[~aside]
    bias = math.log((yt.sum() + 1) / (len(yt) - yt.sum() + 1))
    score, trees, cuts = np.full(len(yt), bias), [], _cuts(xt)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(xt, yt - p, p * (1 - p), cuts, depth, rate)
        trees.append(tree)
        score += _apply(tree, xt)
    forest = Forest(tuple(trees), bias)
    s, t, a, b = raw(forest, x[aside]), y[aside], 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * s + b)))
        a -= 0.05 * (((p - t) * s).mean() + 0.01 * (a - 1))
        b -= 0.05 * (p - t).mean()
    return Forest(forest.trees, bias, float(a), float(b))


def as_column(forest: Forest, x: Column) -> Column:
    """The calibrated probability for an array column of features."""

    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, c, a, b = tree
        return F.when(F.get(x, F.lit(f)) <= c, node(a)).otherwise(node(b))

    total = F.lit(forest.bias)
    for tree in forest.trees:
        total = total + node(tree)
    return 1 / (1 + F.exp(-(total * forest.slope + forest.shift)))
