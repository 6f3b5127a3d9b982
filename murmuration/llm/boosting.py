"""Small gradient-boosted trees over integer features, trained on weighted rows and scored as column expressions.

Trees grow from sums by node, feature and value. These come from arrays on the driver or from a table in the cluster; the
sums are of whole numbers and leaves are multiples of 1 / GRID, so that no order of rows changes them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Levels of a tree at most.
DEPTH = 3
#: Parts of one that gradients are summed in, and that leaves are multiples of.
UNIT, GRID = 1 << 20, 1 << 10
#: No leaf is larger, so that scores take a bounded number of values.
LARGEST_LEAF = 8.0


@dataclass
class Split:
    feature: str
    above: float
    low: Split | float
    high: Split | float

    def names(self) -> set[str]:
        return {self.feature}.union(*(x.names() for x in (self.low, self.high) if isinstance(x, Split)))

    def flat(self, names: list[str], depth: int) -> tuple[list[int], list[float], list[float]]:
        """Features and thresholds of a full tree in order of level, and its leaves: a leaf higher up is repeated below."""
        features, above, level = [], [], [self]
        for _ in range(depth):
            below = []
            for x in level:
                split = isinstance(x, Split)
                features.append(names.index(x.feature) if split else 0)
                above.append(x.above if split else float("inf"))
                below += [x.low, x.high] if split else [x, x]
            level = below
        return features, above, [float(x) for x in level]

    def values(self, features: dict[str, np.ndarray]) -> np.ndarray:
        side = lambda x: x.values(features) if isinstance(x, Split) else x
        return np.where(features[self.feature] > self.above, side(self.high), side(self.low))

    def column(self) -> Column:
        side = lambda x: x.column() if isinstance(x, Split) else F.lit(x)
        return F.when(F.col(self.feature) > self.above, side(self.high)).otherwise(side(self.low))


#: By node and feature: the values that occur, and the sums of gradients and curvatures at each.
Sums = dict[int, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Booster:
    """Log-odds are bias + the sum of trees; calibration is a further linear map of them."""

    bias: float
    trees: list[Split]
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def train(cls, features: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray, rounds: int = 24, depth: int = DEPTH, rate: float = 0.4) -> Booster:
        return cls.grown(Held(features, positive * weight, weight), rounds, depth, rate)

    @classmethod
    def grown(cls, rows: Held | Spread, rounds: int = 24, depth: int = DEPTH, rate: float = 0.4) -> Booster:
        share = np.clip(rows.positive / rows.total, 1e-6, 1 - 1e-6)
        out = cls(_on_grid(np.log(share / (1 - share))), [])
        rows.add(out.bias)
        for _ in range(rounds):
            tree = _grow(rows.sums, depth, rate)
            if not isinstance(tree, Split):
                break
            out.trees.append(tree)
            rows.add(tree)
        return out

    def scores(self, features: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(features.values())))
        return self.bias + sum((t.values(features) for t in self.trees), np.zeros(n))

    def calibrate(self, features: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray) -> None:
        self.calibrate_scores(self.scores(features), positive, weight)

    def calibrate_scores(self, x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> None:
        """Fits scale and shift of the log-odds on rows that training has not seen, by Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(25):
            p = _sigmoid(a * x + b)
            g = np.array([(weight * (positive - p) * x).sum(), (weight * (positive - p)).sum()]) - 1e-3 * np.array([a - 1, b])
            c = weight * p * (1 - p)
            h = np.array([[(c * x * x).sum(), (c * x).sum()], [(c * x).sum(), c.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        self.scale, self.shift = a, b

    def probabilities(self, features: dict[str, np.ndarray]) -> np.ndarray:
        return self.probability_at(self.scores(features))

    def probability_at(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * scores + self.shift)

    def column(self) -> Column:
        """The probability over columns named as the features."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.score_column() * self.scale + self.shift)))

    def score_column(self) -> Column:
        """The score over such columns. Trees are data that a lambda walks: as conditions written out they would make
        generated code of a size that takes the compiler gigabytes."""
        names = sorted({name for t in self.trees for name in t.names()})
        score = F.lit(self.bias)
        if names:
            lits = lambda xs: F.array(*map(F.lit, xs))
            x, trees = F.array(*(F.col(n).cast("double") for n in names)), [t.flat(names, DEPTH) for t in self.trees]
            table = F.array(*(F.struct(lits(f).alias("feature"), lits(a).alias("above"), lits(v).alias("leaf")) for f, a, v in trees))

            def leaf(tree: Column) -> Column:
                at = F.lit(0)
                for _ in range(DEPTH):
                    at = at * 2 + 1 + (F.get(x, F.get(tree.feature, at)) > F.get(tree.above, at)).cast("int")
                return F.get(tree.leaf, at - (2**DEPTH - 1))

            score = F.aggregate(table, score, lambda total, tree: total + leaf(tree))
        return score


class Held:
    """Training rows on the driver: weights, and how much of each is positive."""

    def __init__(self, features: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray):
        self.features, self._positive, self.weight = features, positive, weight
        self.positive, self.total, self.score = float(positive.sum()), float(weight.sum()), np.zeros(len(weight))

    def add(self, tree: Split | float) -> None:
        self.score = self.score + (tree.values(self.features) if isinstance(tree, Split) else tree)

    def sums(self, nodes: Split | float) -> Sums:
        p = _sigmoid(self.score)
        gradient, curve = np.round((self._positive - self.weight * p) * UNIT), np.round(self.weight * p * (1 - p) * UNIT)
        node = nodes.values(self.features) if isinstance(nodes, Split) else np.full(len(p), nodes)
        out: Sums = {}
        for at in np.unique(node):
            rows = np.flatnonzero(node == at)
            for name, x in self.features.items():
                values, where = np.unique(x[rows], return_inverse=True)
                sums = (np.bincount(where, v[rows]) / UNIT for v in (gradient, curve))
                out.setdefault(int(at), {})[name] = (values, *sums)
        return out


class Spread:
    """Training rows in a written table with columns n and positive. The driver gets one row for each node, feature and value."""

    def __init__(self, rows: DataFrame, names: list[str], scratch: Scratch, name: str):
        self.names, self.scratch, self.name, self.round = names, scratch, name, 0
        self.rows = rows.select(*names, "n", "positive", F.lit(0.0).alias("score"))
        sums = rows.agg(F.sum("positive"), F.sum("n")).first()
        self.positive, self.total = float(sums[0]), float(sums[1])

    def add(self, tree: Split | float) -> None:
        more = tree.column() if isinstance(tree, Split) else F.lit(tree)
        self.rows = self.scratch.write(self.rows.withColumn("score", F.col("score") + more), f"{self.name}{self.round + 1}")
        if self.round:
            self.scratch.drop(f"{self.name}{self.round}")
        self.round += 1

    def sums(self, nodes: Split | float) -> Sums:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score")))))
        whole = lambda c: F.rint(c * UNIT).cast("long")
        node = nodes.column() if isinstance(nodes, Split) else F.lit(nodes)
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("long").alias("v")) for i, c in enumerate(self.names))))
        rows = self.rows.select(node.alias("node"), whole(F.col("positive") - F.col("n") * p).alias("g"), whole(F.col("n") * p * (1 - p)).alias("h"), pairs.alias("pair"))
        found = rows.groupBy("node", "pair.f", "pair.v").agg(F.sum("g"), F.sum("h")).collect()
        table: dict[tuple[int, int], list] = {}
        for at, f, v, g, h in sorted(map(tuple, found)):
            table.setdefault((int(at), f), []).append((v, g / UNIT, h / UNIT))
        out: Sums = {}
        for (at, f), cells in table.items():
            out.setdefault(at, {})[self.names[f]] = tuple(np.array(c) for c in zip(*cells, strict=True))
        return out


def _on_grid(x: float) -> float:
    return float(np.round(x * GRID) / GRID)


def _grow(sums: Callable[[Split | float], Sums], depth: int, rate: float) -> Split | float:
    """A tree, level by level; its nodes are numbered as in a heap, and sums() gets the tree so far with numbers as leaves."""
    splits: dict[int, tuple[str, float]] = {}
    leaves = {0: 0.0}

    def tree(at: int, leaf: Callable[[int], float]) -> Split | float:
        if at not in splits:
            return leaf(at)
        return Split(*splits[at], tree(2 * at + 1, leaf), tree(2 * at + 2, leaf))

    value = lambda g, h: _on_grid(np.clip(rate * g / h, -LARGEST_LEAF, LARGEST_LEAF))
    level = [0]
    for _ in range(depth):
        found = sums(tree(0, float)) if level else {}
        here, level = [at for at in level if at in found], []
        for at in here:
            best = (1e-6, None, None, None)
            for name, (values, gs, hs) in found[at].items():
                g, h = gs.sum(), hs.sum() + 1.0
                leaves[at] = value(g, h)
                if len(values) < 2:
                    continue
                gs, hs = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs) - g**2 / h
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), name, float((values[k] + values[k + 1]) / 2), (value(gs[k], hs[k] + 1), value(g - gs[k], h - hs[k])))
            if best[1] is not None:
                splits[at] = best[1:3]
                leaves[2 * at + 1], leaves[2 * at + 2] = best[3]
                level += [2 * at + 1, 2 * at + 2]
    return tree(0, lambda at: leaves[at])
