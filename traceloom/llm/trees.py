"""Gradient boosting for the logistic loss with trees of depth 3 over binned features, grown from sums.

A level of a tree needs, for each of its nodes, features and bins, how many rows there are and the sums of their
gradients and curvatures.  ``grow`` asks for them level by level; whether an array or a table holds the rows is the
caller's affair.  The sums are of whole numbers, so neither they nor the trees depend on the order or the parts of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Gradients and curvatures are whole multiples of 2**-BITS.
BITS = 26
ONE = 1 << BITS
#: Rows that a node must hold to be split.
LEAST_ROWS = 20


def _places(rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """For each row and tree, the node of a level: trees by row, nodes numbered from the root, level by level."""
    tree, node = np.arange(len(feature)), np.zeros((len(rows), len(feature)), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (np.take_along_axis(rows, feature[tree, node], 1) > cut[tree, node])
    return node - (2**levels - 1)


class Trees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.cuts = 0.0, []
        # of each tree: feature and bin by which its inner nodes split, values of its leaves
        self.feature, self.cut, self.value = np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth))

    def begin(self, cuts: list[np.ndarray], rows: int, positives: int) -> "Trees":
        p = float(np.clip(positives / rows if rows else 0.5, 1e-3, 1 - 1e-3))
        self.cuts, self.start = cuts, float(np.log(p / (1 - p)))
        return self

    def quantiles(self) -> list[float]:
        return np.linspace(0, 1, self.bins + 1)[1:-1].tolist()

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        one, y = np.ones(len(y), np.int64), y.astype(np.int64)
        self.begin([np.unique(np.quantile(c, self.quantiles())) for c in x.T], len(y), int(y.sum()))
        rows = self.binned(x)
        grow({0: self}, lambda now: {0: now[0].sums(rows, one, y)})
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.uint8)

    def of_binned(self, rows: np.ndarray) -> np.ndarray:
        leaf = _places(rows, self.feature, self.cut, self.depth)
        f = self.start + self.value[np.arange(len(self.value)), leaf].sum(1)
        return 1 / (1 + np.exp(-f))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of_binned(self.binned(x))


class Growing:
    """The tree that comes next: ``level`` levels of it are split, and the nodes ``open`` of the next may be."""

    def __init__(self, trees: Trees):
        inner = 2**trees.depth - 1
        self.trees, self.level, self.open = trees, 0, [0]
        # a node that is not split passes all rows on to its lower side
        self.feature, self.cut, self.value = np.zeros(inner, np.int64), np.full(inner, trees.bins, np.int64), np.zeros(inner + 1)

    def sums(self, rows: np.ndarray, n: np.ndarray, positives: np.ndarray) -> np.ndarray:
        """Rows, gradients and curvatures by node, feature and bin, of binned rows that each stand for ``n``."""
        nodes, features = 2**self.level, len(self.trees.cuts)
        at = _places(rows, self.feature[None], self.cut[None], self.level)[:, 0]
        used = np.isin(at, self.open) & (n > 0)
        rows, n, positives, at = rows[used], n[used], positives[used], at[used]
        p = np.rint(ONE * self.trees.of_binned(rows)).astype(np.int64)
        cell = ((at * features)[:, None] + np.arange(features)) * self.trees.bins + rows
        weights = n, positives * ONE - n * p, n * (p * (ONE - p) >> BITS)
        out = [np.bincount(cell.ravel(), np.repeat(w, features), nodes * features * self.trees.bins) for w in weights]
        return np.array(out).astype(np.int64).reshape(3, nodes, features, self.trees.bins)

    def split(self, sums: np.ndarray) -> None:
        """Split the open nodes of a level where that gains, and give the others their values."""
        depth, last, found = self.trees.depth, self.level + 1 == self.trees.depth, []
        value = lambda g, h: self.trees.rate * g / (h + 1)
        for node in self.open:
            n, (g, h) = sums[0, node], sums[1:, node] / ONE
            total, total_g, total_h = n[0].sum(), g[0].sum(), h[0].sum()
            self.value[node << depth - self.level] = value(total_g, total_h)
            low, gs, hs = (c.cumsum(axis=1)[:, :-1] for c in (n, g, h))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(low == 0) | (low == total)] = 0
            j, k = np.unravel_index(gain.argmax(), gain.shape)
            if total < LEAST_ROWS or gain[j, k] <= 1e-6:
                continue
            self.feature[2**self.level - 1 + node], self.cut[2**self.level - 1 + node] = j, k
            if last:
                self.value[2 * node], self.value[2 * node + 1] = value(gs[j, k], hs[j, k]), value(total_g - gs[j, k], total_h - hs[j, k])
            found += [2 * node, 2 * node + 1]
        self.level, self.open = self.level + 1, [] if last else found

    def end(self) -> None:
        t = self.trees
        t.feature, t.cut, t.value = np.vstack([t.feature, self.feature]), np.vstack([t.cut, self.cut]), np.vstack([t.value, self.value])


def grow(models: dict, sums: Callable[[dict], dict]) -> None:
    """Grow all trees of all models side by side; ``sums`` gives those of each model's level by the model's name."""
    for _ in range(max((t.rounds for t in models.values()), default=0)):
        new = {k: Growing(t) for k, t in models.items()}
        while now := {k: g for k, g in new.items() if g.open}:
            for k, s in sums(now).items():
                now[k].split(s)
        for g in new.values():
            g.end()
