"""Small gradient-boosted trees over counted feature cells.

Spark counts how often each combination of a few small features occurs, and how often with the label;
the number of cells is bounded by the features' ranges, whatever the input. Trees are fitted to the counts,
and a fitted model is a Column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, RATE, DEPTH, PENALTY = 30, 0.3, 2, 1.0


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    most: int = 0
    low: Node | None = None
    high: Node | None = None

    def score(self, x: tuple[int, ...]) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.most else node.high
        return node.value

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.most, self.low.column(features)).otherwise(self.high.column(features))


@dataclass
class Model:
    base: float
    trees: list[Node] = field(default_factory=list)
    threshold: float = float("inf")

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + exp(-max(-60.0, min(60.0, self.base + sum(t.score(x) for t in self.trees)))))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(features)
        return 1 / (1 + F.exp(-total))


def _grow(cells: list[tuple[tuple[int, ...], float, float]], depth: int) -> Node:
    """cells: (features, gradient, curvature) sums."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, gain = None, 1e-6
    if depth:
        for f in range(len(cells[0][0])):
            by: dict[int, list[float]] = {}
            for x, a, b in cells:
                at = by.setdefault(x[f], [0.0, 0.0])
                at[0] += a
                at[1] += b
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                found = lg * lg / (lh + PENALTY) + (g - lg) ** 2 / (h - lh + PENALTY) - g * g / (h + PENALTY)
                if found > gain:
                    best, gain = (f, v), found
    if best is None:
        return Node(RATE * g / (h + PENALTY))
    f, v = best
    return Node(0.0, f, v, _grow([c for c in cells if c[0][f] <= v], depth - 1), _grow([c for c in cells if c[0][f] > v], depth - 1))


def fit(cells: list[tuple[tuple[int, ...], int, int]], trees: int = TREES) -> Model:
    """cells: (features, rows, rows with the label). Logistic loss, Newton steps."""
    n, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Model(log((pos + 1) / (n - pos + 1)))
    if not pos or pos == n:
        return model
    margin = [model.base] * len(cells)
    for _ in range(trees):
        steps = []
        for m, (x, c, y) in zip(margin, cells, strict=True):
            p = 1 / (1 + exp(-max(-60.0, min(60.0, m))))
            steps.append((x, y - c * p, c * p * (1 - p)))
        tree = _grow(steps, DEPTH)
        model.trees.append(tree)
        margin = [m + tree.score(c[0]) for m, c in zip(margin, cells, strict=True)]
    return model


def calibrate(model: Model, cells: list[tuple[tuple[int, ...], int, int]], precision: float) -> Model:
    """Set the smallest threshold from which on held-back cells have this share of labels; none if there is none."""
    by: dict[float, list[int]] = {}
    for x, c, y in cells:
        at = by.setdefault(round(model.score(x), 9), [0, 0])
        at[0] += c
        at[1] += y
    n = pos = 0
    for s in sorted(by, reverse=True):
        n, pos = n + by[s][0], pos + by[s][1]
        if pos >= precision * n:
            model.threshold = s - 1e-8
    return model
