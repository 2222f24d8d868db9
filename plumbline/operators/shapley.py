"""Shapley values of margins: exact for tree ensembles, closed form for linear scorers.

Path-dependent tree values (Lundberg et al.): for a leaf reached over the
distinct path features P, a row matters only through which of the |P| intervals
hold its values. So a subtree of few leaves gives a row what the turns at its nodes and at
those above it say, and all answers are listed once in a table. A batch then takes
the turns and reads the tables, tree by tree. Workers hold the tables, at most
2^``TURNS`` numbers for each subtree and feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline.functions.arrays import KEY, unpivot_array
from plumbline.functions.vectors import list_array, matrix_of
from plumbline.operators.modeling import LogisticScorer
from plumbline.operators.profiling import bucket
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.trees import Ensemble

# Most turns of which one table lists all combinations; deeper leaves are valued one by one.
TURNS = 8


def leaf_paths(ensemble: Ensemble) -> list[tuple]:
    """Per leaf ``(value, positions, lows, highs, cover ratios)``; one entry per distinct feature."""
    return [leaf for tree in ensemble.by_tree().values() for leaf in paths_below(ensemble, tree, [])]


def paths_below(ensemble: Ensemble, tree: dict[int, tuple], above: list[tuple[int, int]]) -> list[tuple]:
    """``leaf_paths`` of the leaves of one tree to which the turns ``above`` lead: nodes from the root, 0 for left."""
    position = {f: i for i, f in enumerate(ensemble.features)}

    def narrowed(path: dict, node: int, turn: int) -> tuple[int, dict]:
        _, _, _, name, cut, left, right, cover, _ = tree[node]
        low, high, kept = path.get(position[name], (-np.inf, np.inf, 1.0))
        child = right if turn else left
        interval = (max(low, cut), high) if turn else (low, min(high, cut))
        return child, {**path, position[name]: (*interval, kept * tree[child][7] / cover)}

    node, path = 0, {}
    for node, turn in above:
        node, path = narrowed(path, node, turn)
    leaves, stack = [], [(node, path)]
    while stack:
        node, path = stack.pop()
        _, weight, _, _, _, left, _, _, value = tree[node]
        if left >= 0:
            stack += [narrowed(path, node, turn) for turn in (0, 1)]
            continue
        entries = sorted(path.items())
        leaves.append(
            (
                ensemble.scale * weight * value,
                np.array([f for f, _ in entries], dtype=np.int64),
                np.array([e[0] for _, e in entries]),
                np.array([e[1] for _, e in entries]),
                np.array([e[2] for _, e in entries]),
            )
        )
    return leaves


def leaf_contributions(inside: np.ndarray, kept: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of one leaf for 0/1 columns ``inside`` (path features x rows).

    The mean over subsets of the other features is the integral over t in [0, 1] of
    the product of their ``kept_j + (inside_j - kept_j) t``, a polynomial that Gauss
    points integrate exactly. Each feature's own factor is divided out of the whole
    product; it is positive inside the interval because covers are.
    """
    m = len(kept)
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    gain = inside - kept[:, None]
    total = np.zeros(inside.shape)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        factors = kept[:, None] + gain * t
        total += w * factors.prod(axis=0) / factors
    return value * gain * total


def tree_values(leaves: list[tuple], x: np.ndarray) -> np.ndarray:
    """Shapley values of the rows of ``x``, leaf by leaf; NaN goes right at every split, as when scoring."""
    columns = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T)
    phi = np.zeros(columns.shape)
    for value, features, lows, highs, kept in leaves:
        if not len(features):
            continue
        path = columns[features]
        inside = ((path > lows[:, None]) & (path <= highs[:, None])).astype(np.float64)
        phi[features] += leaf_contributions(inside, kept, value)
    return np.ascontiguousarray(phi.T)


@dataclass
class Turn:
    """A split above the tables: a feature's place, the cut, and what lies left and right."""

    feature: int
    cut: float
    below: tuple


@dataclass
class Answers:
    """A subtree: its splits, and for each feature the values by the turns above and inside it, the first turn highest."""

    splits: list[tuple[int, float]]
    features: list[int]
    table: np.ndarray


def tree_plans(ensemble: Ensemble) -> list:
    """Per tree a ``Turn`` or ``Answers``, or ``leaf_paths`` of leaves that lie too deep for a table."""
    position = {f: i for i, f in enumerate(ensemble.features)}

    def splits_of(tree: dict, node: int) -> list[int]:
        _, _, _, _, _, left, right, _, _ = tree[node]
        return [] if left < 0 else [node, *splits_of(tree, left), *splits_of(tree, right)]

    def answers(tree: dict, node: int, above: list[tuple[int, int]]) -> Answers:
        inner = splits_of(tree, node)
        nodes = [n for n, _ in above] + inner
        codes = np.arange(1 << len(nodes))
        right = {n: (codes >> (len(nodes) - 1 - i)) & 1 == 1 for i, n in enumerate(nodes)}
        features = sorted({position[tree[n][3]] for n in nodes})
        table = np.zeros((len(features), len(codes)))
        stack = [(node, above)]
        while stack:
            n, path = stack.pop()
            _, weight, _, _, _, low, high, _, value = tree[n]
            if low >= 0:
                stack += [(low, [*path, (n, 0)]), (high, [*path, (n, 1)])]
                continue
            kept, inside = {}, {}
            for m, turn in path:
                f = position[tree[m][3]]
                kept[f] = kept.get(f, 1.0) * tree[tree[m][6 if turn else 5]][7] / tree[m][7]
                inside[f] = inside.get(f, True) & (right[m] == bool(turn))
            if path:
                rows = [features.index(f) for f in kept]
                held = np.array([inside[f] for f in kept], np.float64)
                table[rows] += leaf_contributions(held, np.array(list(kept.values())), ensemble.scale * weight * value)
        return Answers([(position[tree[n][3]], tree[n][4]) for n in inner], features, table)

    def plan(tree: dict, node: int, above: list[tuple[int, int]], inner: int):
        if len(above) + inner <= TURNS:
            return answers(tree, node, above)
        if len(above) >= TURNS:
            return paths_below(ensemble, tree, above)
        below = []
        for turn, child in enumerate(tree[node][5:7]):
            below.append(plan(tree, child, [*above, (node, turn)], len(splits_of(tree, child))))
        return Turn(position[tree[node][3]], tree[node][4], tuple(below))

    return [plan(tree, 0, [], len(splits_of(tree, 0))) for tree in ensemble.by_tree().values()]


def planned_values(plans: list, x: np.ndarray) -> np.ndarray:
    """Shapley values of the rows of ``x`` by ``tree_plans``; NaN goes right at every split, as when scoring."""
    columns = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T)
    phi = np.zeros(columns.shape)

    def add(part, code: np.ndarray) -> None:
        if isinstance(part, Turn):
            code = (code << 1) | (columns[part.feature] > part.cut)
            for child in part.below:
                add(child, code)
        elif isinstance(part, Answers):
            for feature, cut in part.splits:
                code = (code << 1) | (columns[feature] > cut)
            at = code.astype(np.intp)
            for feature, values in zip(part.features, part.table, strict=True):
                phi[feature] += values.take(at)
        else:
            phi.T[...] += tree_values(part, x)

    if len(x):
        for part in plans:
            add(part, np.zeros(len(x), np.uint8))
    return np.ascontiguousarray(phi.T)


def linear_values(weights, means, stds, x: np.ndarray) -> np.ndarray:
    return weights * (x - means) / stds


def _without_class(values, x: np.ndarray, classes) -> np.ndarray:
    return values(x)


class TreeShap:
    """Exact tree values in margin units; ``explain`` adds ``phi`` row by row, without a shuffle."""

    def __init__(self, ensemble: Ensemble):
        self.features = ensemble.features
        self.leaves = leaf_paths(ensemble)
        self.plans = tree_plans(ensemble)
        self.base = float(sum(t[0] * np.prod(t[4]) for t in self.leaves))

    def explain(self, df: DataFrame) -> DataFrame:
        shipped = df.sparkSession.sparkContext.broadcast(self.plans)

        @F.arrow_udf(ArrayType(DoubleType()))
        def values(x: pa.Array) -> pa.Array:
            return list_array(planned_values(shipped.value, matrix_of(x)))

        return df.withColumn("phi", values("x"))

    def batch_function(self):
        """``(x, classes) -> phi`` for a batch; the class plays no part."""
        return partial(_without_class, partial(planned_values, self.plans))


class LinearShap:
    """Shapley values of a linear margin with independent features: ``w (x - mean) / std``."""

    def __init__(self, scorer: LogisticScorer, features: list[str]):
        self.features = features
        self.scorer = scorer
        self.base = scorer.bias

    def explain(self, df: DataFrame) -> DataFrame:
        return df.withColumn("phi", self.scorer.contributions("x"))

    def batch_function(self):
        """``(x, classes) -> phi`` for a batch; the class plays no part."""
        weights, means, stds = (np.array(v) for v in (self.scorer.weights, self.scorer.means, self.scorer.stds))
        return partial(_without_class, partial(linear_values, weights, means, stds))


def long_values(explained: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """``(id, feature, feature_pos, phi)``."""
    return unpivot_array(explained, "phi", features, [key], "phi")


def global_importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, feature_pos, importance)``: mean |phi| by falling importance.

    One aggregate per feature over the array, so nothing is exploded.
    """
    sums = explained.agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(j + 1).alias("feature_pos"),
                F.avg(F.abs(F.col("phi")[j])).alias("importance"),
            ).alias(f"s{j}")
            for j, f in enumerate(features)
        ]
    )
    rows = sums.select(F.inline(F.array(*[f"s{j}" for j in range(len(features))])))
    return rows.orderBy(F.desc("importance"), "feature_pos")


def summary_bins(
    explained: DataFrame, features: list[str], value_bins: int = 4, phi_bins: int = 20, top: int = 20
) -> DataFrame:
    """Counts ``(feature, value_bin, phi_bin, n)`` of phi against the feature's value.

    Value bins are quantile bins of each feature, phi bins are equal widths
    between its smallest and largest phi. Only the ``top`` features by mean
    |phi| are kept, as in a summary plot.
    """
    pairs = explained.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.col("x")[j].alias("value"),
                        F.col("phi")[j].alias("phi"),
                    )
                    for j, f in enumerate(features)
                ]
            )
        )
    )
    chosen = global_importance(explained, features).limit(top).select("feature")
    limits = pairs.groupBy("feature").agg(F.min("phi").alias("low"), F.max("phi").alias("high"))
    probs = [i / value_bins for i in range(1, value_bins)]
    cuts = (
        exact_quantiles(pairs, ["feature"], "value", probs)
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list("quantile")).alias("cuts"))
    )
    small = limits.join(F.broadcast(cuts), "feature").join(F.broadcast(chosen), "feature")
    value_bin = sum(
        (F.when(F.col("value") > F.col("cuts")[i], 1).otherwise(0) for i in range(len(probs))),
        F.lit(0),
    )
    return (
        pairs.join(F.broadcast(small), "feature")
        .select(
            "feature",
            value_bin.alias("value_bin"),
            bucket(F.col("phi"), F.col("low"), F.col("high"), phi_bins).alias("phi_bin"),
        )
        .groupBy("feature", "value_bin", "phi_bin")
        .agg(F.count("*").alias("n"))
    )
