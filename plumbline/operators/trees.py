"""Tree ensembles as a small node table, and vectorised scoring over Arrow batches.

The table is bounded by the model's size (trees x 2^depth nodes), never by the
data, so it is held on the driver and shipped to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODE_SCHEMA = (
    "tree int, weight double, node int, feature string, threshold double, "
    "left int, right int, cover double, value double"
)


def nodes_frame(spark: SparkSession, nodes: list[tuple]) -> DataFrame:
    return spark.createDataFrame(nodes, NODE_SCHEMA)


@dataclass
class Ensemble:
    """Node rows (see ``NODE_SCHEMA``), the feature order, and the margin's scale.

    The margin is ``scale * sum(weight * leaf value)``; ``x <= threshold`` goes left.
    """

    nodes: list[tuple]
    features: list[str]
    scale: float = 1.0

    def by_tree(self) -> dict[int, dict[int, tuple]]:
        trees: dict[int, dict[int, tuple]] = {}
        for row in self.nodes:
            trees.setdefault(row[0], {})[row[2]] = row
        return trees

    def margin_column(self, x: str = "x") -> Column:
        """The margin as one nested conditional per tree; for a handful of shallow trees."""
        position = {f: i for i, f in enumerate(self.features)}

        def branch(tree, node):
            _, weight, _, feature, threshold, left, right, _, value = tree[node]
            if left < 0:
                return F.lit(self.scale * weight * value)
            test = F.col(x)[position[feature]] <= F.lit(threshold)
            return F.when(test, branch(tree, left)).otherwise(branch(tree, right))

        parts = [branch(tree, 0) for tree in self.by_tree().values()]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    def margin_arrays(self):
        """Flat node arrays ``(feature, threshold, children, value, roots, depth)``.

        ``children`` holds the left and the right child of node ``i`` at ``2 i``
        and ``2 i + 1``. Leaves point at themselves, so every row takes the same
        number of steps.
        """
        position = {f: i for i, f in enumerate(self.features)}
        trees = self.by_tree()
        index = {(t, n): i for i, (t, n) in enumerate((t, n) for t in trees for n in trees[t])}
        size = len(index)
        feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        children = np.repeat(np.arange(size), 2)
        for (t, n), i in index.items():
            _, weight, _, name, cut, lo, hi, _, leaf = trees[t][n]
            if lo < 0:
                value[i] = self.scale * weight * leaf
            else:
                feature[i], threshold[i] = position[name], cut
                children[2 * i], children[2 * i + 1] = index[t, lo], index[t, hi]

        def depth(tree, n):
            lo, hi = tree[n][5], tree[n][6]
            return 0 if lo < 0 else 1 + max(depth(tree, lo), depth(tree, hi))

        roots = np.array([index[t, 0] for t in trees])
        deepest = max(depth(tree, 0) for tree in trees.values())
        return feature, threshold, children, value, roots, deepest


def leaf_nodes(arrays, x: np.ndarray) -> np.ndarray:
    """Place of the leaf of each row of ``x`` in each tree; all trees step down together, NaN to the right."""
    feature, threshold, children, _, roots, depth = arrays
    flat, start = x.ravel(), (np.arange(x.shape[0]) * x.shape[1])[:, None]
    at = np.repeat(roots[None, :], x.shape[0], axis=0)
    for _ in range(depth):
        right = ~(flat.take(start + feature.take(at)) <= threshold.take(at))
        at = children.take(2 * at + right)
    return at


def leaf_values(arrays, x: np.ndarray) -> np.ndarray:
    """Weighted value of each row of ``x`` in each tree."""
    return arrays[3].take(leaf_nodes(arrays, x))


def ensemble_margins(arrays, x: np.ndarray) -> np.ndarray:
    """Margins of the rows of ``x``."""
    return leaf_values(arrays, x).sum(axis=1)


def staged_margins(arrays, x: np.ndarray) -> np.ndarray:
    """Margins of the rows of ``x`` by the first tree, the first two, and so on, in one pass."""
    return np.cumsum(leaf_values(arrays, x), axis=1)


@dataclass
class ReplacementIndex:
    """Where a feature matters: ``trees`` that split on it, and for each node the
    nearest node ``above`` it that splits on the same feature (-1 if none).

    ``arrays`` are those of ``margin_arrays``; all is bounded by the model's size.
    """

    arrays: tuple
    trees: list[np.ndarray]
    above: np.ndarray

    @classmethod
    def of(cls, ensemble: Ensemble) -> ReplacementIndex:
        arrays = ensemble.margin_arrays()
        feature, _, children, _, roots, _ = arrays
        above, used = np.full(len(feature), -1), [set() for _ in ensemble.features]
        for tree, root in enumerate(roots):
            stack = [(int(root), {})]
            while stack:
                node, last = stack.pop()
                left, right = int(children[2 * node]), int(children[2 * node + 1])
                if left == node:
                    continue
                j = int(feature[node])
                used[j].add(tree)
                above[node] = last.get(j, -1)
                below = {**last, j: node}
                stack += [(left, below), (right, below)]
        return cls(arrays, [np.array(sorted(u), np.int64) for u in used], above)

    def replace_each(self, x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of ``x``, and for each feature the margins with that feature's value from ``new``.

        A replaced value changes a tree's answer only where it turns a row at a node on
        its way. Each row steps down once; the first such turn of each feature in each
        tree is followed to its leaf, and the difference is added up. Rows that
        do not turn cost nothing.
        """
        feature, threshold, children, value, roots, depth = self.arrays
        n, width = x.shape
        flat, fresh = x.ravel(), new.ravel()
        start = (np.arange(n) * width)[:, None]
        at = np.repeat(roots[None, :], n, axis=0)
        turns = []
        for level in range(depth):
            place, cut = start + feature.take(at), threshold.take(at)
            right = ~(flat.take(place) <= cut)
            turned = right != ~(fresh.take(place) <= cut)
            hit = np.flatnonzero(turned)
            node, place = at.ravel()[hit], place.ravel()[hit]
            first = children[2 * node] != node
            up = np.where(first, self.above[node], -1)
            while (up >= 0).any():
                cut = threshold[up]
                first &= (up < 0) | ((flat[place] <= cut) == (fresh[place] <= cut))
                up = np.where(up >= 0, self.above[up], -1)
            hit, node, place = hit[first], node[first], place[first]
            turns.append((hit, place, children[2 * node + ~right.ravel()[hit]], depth - level - 1))
            at = children.take(2 * at + right)
        held = value.take(at)
        margins = held.sum(axis=1)
        moved = np.zeros(n * width)
        for hit, place, node, steps in turns:
            line, own = (place // width) * width, place % width
            for _ in range(steps):
                j = feature[node]
                seen = np.where(j == own, fresh[place], flat[line + j])
                node = children[2 * node + ~(seen <= threshold[node])]
            moved += np.bincount(place, value[node] - held.ravel()[hit], n * width)
        return margins, margins[:, None] + moved.reshape(n, width)

    def replace_in_order(self, x: np.ndarray, new: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of ``x``, and those after each row's features of rank 1, 2, ... took their values from ``new``.

        In each step rows are taken by the feature they replace, and only the trees that
        split on it are scored again.
        """
        feature, threshold, children, value, roots, depth = self.arrays
        rows, held = x.copy(), leaf_values(self.arrays, x)
        start, out = held.sum(axis=1), np.zeros(x.shape)
        now = start.copy()
        for k in range(1, x.shape[1] + 1):
            line, chosen = np.nonzero(ranks == k)
            for j in np.unique(chosen):
                own = line[chosen == j]
                rows[own, j] = new[own, j]
                trees = self.trees[j]
                if len(trees):
                    some = (feature, threshold, children, value, roots[trees], depth)
                    held[own[:, None], trees[None, :]] = leaf_values(some, rows[own])
                    now[own] = held[own].sum(axis=1)
            out[:, k - 1] = now
        return start, out
