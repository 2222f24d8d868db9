"""Fidelity: how far the prediction moves when important features are replaced.

``analyze_fidelity`` and ``fidelity_curve`` perturb, score and fold whole batches in
the task that holds the rows. The long forms (``perturb_single``,
``feature_impacts``, ``perturb_top_k``) show the perturbed rows themselves.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline.functions.arrays import KEY, literal_array, literal_names, replace_at
from plumbline.functions.guards import drop_nan, pearson
from plumbline.functions.hashing import hash_key
from plumbline.functions.vectors import (
    explode_positions,
    importance_ranks,
    list_array,
    matrix_of,
    rank_at,
    rank_matrix,
)
from plumbline.operators.numbering import number_rows

STRATEGIES = ("mean", "median", "zero", "random")


def with_donors(df: DataFrame, seed: int = 42, key: str = KEY) -> DataFrame:
    """Each row with ``donor``, the features of another row drawn at random from the whole table.

    Rows are numbered in two hash orders and the k-th of one gives to the k-th of the
    other, so every row gives once and receives once, by one join on a number.
    """
    first = df.withColumn("__h", hash_key(seed, F.col(key), "donor"))
    second = df.withColumn("__h", hash_key(seed, F.col(key), "draw"))
    giving = number_rows(first, "__h", "__slot", key=key).select("__slot", F.col("x").alias("donor"))
    taking = number_rows(second, "__h", "__slot", key=key)
    return taking.join(giving, "__slot").select(*df.columns, "donor")


def rank_features(explained: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """``(id, rank, feature, feature_pos, phi)`` by falling |phi|; ties keep feature order."""
    rows = explained.withColumn("ranks", importance_ranks("phi")).select(
        key, "phi", "ranks", explode_positions("x").alias("pos", "value")
    )
    return rows.select(
        key,
        rank_at("pos").alias("rank"),
        literal_names(features)[F.col("pos")].alias("feature"),
        (F.col("pos") + 1).alias("feature_pos"),
        F.col("phi")[F.col("pos")].alias("phi"),
    ).where(F.col("rank") > 0)


def top_k_features(
    explained: DataFrame, features: list[str], k: int = 10, key: str = KEY
) -> DataFrame:
    """The ``k`` highest ranked features of each row."""
    return rank_features(explained, features, key).where(F.col("rank") <= k)


def _ranked_count() -> Column:
    return F.size(F.array_remove("ranks", 0))


def perturb_single(
    explained: DataFrame,
    values: Column,
    key: str = KEY,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per explained feature with that feature replaced, and its rank.

    ``values`` holds the replacement by position: one array for all rows, or a column.
    """
    rows = (
        explained.withColumn("ranks", importance_ranks("phi"))
        .withColumn("n_ranked", _ranked_count())
        .select(
            key,
            *keep,
            "x",
            "phi",
            "ranks",
            "n_ranked",
            values.alias("values"),
            explode_positions("x").alias("pos", "value"),
        )
        .where(rank_at("pos") > 0)
    )
    value = F.col("values")[F.col("pos")]
    return rows.select(
        key,
        *keep,
        "n_ranked",
        rank_at("pos").alias("rank"),
        (F.col("pos") + 1).alias("feature_pos"),
        F.abs(F.col("phi")[F.col("pos")]).alias("importance"),
        replace_at("x", "pos", value).alias("x"),
    )


def feature_impacts(
    explained: DataFrame,
    scorer,
    values: Column,
    space: str = "p",
    key: str = KEY,
) -> DataFrame:
    """``(id, n_ranked, rank, feature_pos, importance, impact)``: |change of ``space``|.

    ``explained`` has ``x``, ``phi`` and the original score in ``space``
    (``p`` or ``margin``). All perturbed rows go through one scoring pass.
    """
    before = explained.withColumnRenamed(space, "before").drop("margin" if space == "p" else "p")
    rows = perturb_single(before, values, key, keep=("before",))
    return scorer.score(rows).select(
        key,
        "n_ranked",
        "rank",
        "feature_pos",
        "importance",
        F.abs(F.col("before") - F.col(space)).alias("impact"),
    )


def row_fidelity(impacts: DataFrame, key: str = KEY) -> DataFrame:
    """``(id, aufc, correlation)``.

    The trapezoid over unit steps is the sum less half of both ends. The
    correlation is 0 if either side is all zero or fewer than two pairs are
    defined, and null if one side is constant but not zero.
    """
    importance, impact = drop_nan(F.col("importance")), drop_nan(F.col("impact"))
    pairs = F.count_if(importance.isNotNull() & impact.isNotNull())
    ends = F.when(F.col("rank") == 1, F.col("impact")).otherwise(0.0) + F.when(
        F.col("rank") == F.col("n_ranked"), F.col("impact")
    ).otherwise(0.0)
    sums = impacts.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum("impact").alias("total"),
        F.sum(ends).alias("ends"),
        F.max("importance").alias("top_importance"),
        F.max("impact").alias("top_impact"),
        pairs.alias("pairs"),
        pearson(importance, impact).alias("r"),
    )
    flat = (F.col("top_importance") == 0) | (F.col("top_impact") == 0) | (F.col("pairs") < 2)
    return sums.select(
        key,
        F.when(F.col("n") > 1, F.col("total") - F.col("ends") / 2).otherwise(0.0).alias("aufc"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("r")).alias("correlation"),
    )


def perturb_top_k(
    explained: DataFrame,
    values: Column,
    key: str = KEY,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for k = 1 … n with the k most important features replaced."""

    @F.arrow_udf(ArrayType(ArrayType(DoubleType())))
    def steps(x: pa.Array, phi: pa.Array, values: pa.Array) -> pa.Array:
        rows, new, ranks = matrix_of(x), matrix_of(values), rank_matrix(matrix_of(phi))
        width, count = rows.shape[1], (ranks > 0).sum(axis=1)
        owner = np.repeat(np.arange(len(rows)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1
        taken = (ranks[owner] > 0) & (ranks[owner] <= k[:, None])
        inner = list_array(np.where(taken, new[owner], rows[owner]).reshape(-1, width))
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), inner)

    rows = explained.select(key, *keep, F.posexplode(steps("x", "phi", values)).alias("k0", "x"))
    return rows.select(key, *keep, (F.col("k0") + 1).alias("k"), "x")


def replace_each(score, x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of ``x``, and with each feature replaced in turn, by any batch function."""
    rows, out = x.copy(), np.zeros(x.shape)
    for j in range(x.shape[1]):
        rows[:, j] = new[:, j]
        out[:, j] = score(rows)
        rows[:, j] = x[:, j]
    return score(x), out


def replace_in_order(score, x: np.ndarray, new: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of ``x``, and after replacing the features of rank 1, 2, ... by any batch function."""
    rows, out = x.copy(), np.zeros(x.shape)
    for k in range(1, x.shape[1] + 1):
        np.copyto(rows, new, where=ranks == k)
        out[:, k - 1] = score(rows) if len(rows) else 0.0
    return score(x), out


def replacement_functions(scorer, space: str):
    """The scorer's own functions of replaced features, or plain scoring of every replacement."""
    if hasattr(scorer, "replacement_functions"):
        return scorer.replacement_functions(space)
    score = scorer.batch_function(space)
    return partial(replace_each, score), partial(replace_in_order, score)


def fidelity_curve(
    explained: DataFrame, scorer, values: Column, space: str = "p", key: str = KEY
) -> DataFrame:
    """``(id, k, loss)``: squared change after replacing the top k features.

    The features of a whole batch are replaced rank by rank and scored at once, in the
    task that holds the rows; tree ensembles score only the trees a feature splits.
    """
    in_order = explained.sparkSession.sparkContext.broadcast(replacement_functions(scorer, space)[1])

    @F.arrow_udf(ArrayType(DoubleType()))
    def losses(x: pa.Array, phi: pa.Array, values: pa.Array) -> pa.Array:
        rows, ranks = matrix_of(x), rank_matrix(matrix_of(phi))
        start, after = in_order.value(rows, matrix_of(values), ranks)
        out, count = (start[:, None] - after) ** 2, (ranks > 0).sum(axis=1)
        used = np.arange(rows.shape[1]) < count[:, None]
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[used]))

    folded = explained.select(key, losses("x", "phi", values).alias("losses"))
    return folded.select(key, F.posexplode("losses").alias("k0", "loss")).select(
        key, (F.col("k0") + 1).alias("k"), "loss"
    )


def mean_curve(curve: DataFrame) -> DataFrame:
    """``(k, loss, n)`` averaged over the rows."""
    return curve.groupBy("k").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def replacement_values(strategy: str, stats: dict[str, list[float]]) -> Column:
    """Replacement by position for a strategy; ``random`` reads the ``donor`` of each row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}; use one of {', '.join(STRATEGIES)}")
    if strategy == "random":
        return F.col("donor")
    if strategy == "zero":
        return literal_array([0.0] * max(len(v) for v in stats.values()))
    return literal_array(stats[strategy])


def fold_impacts(ranks: np.ndarray, importance: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(aufc, correlation)`` of each row from its features' impacts, as ``row_fidelity`` defines them."""
    known, count = ranks > 0, (ranks > 0).sum(axis=1)
    held = np.where(known, impact, 0.0)
    ends = np.where(ranks == 1, held, 0.0) + np.where(known & (ranks == count[:, None]), held, 0.0)
    aufc = np.where(count > 1, held.sum(axis=1) - ends.sum(axis=1) / 2, 0.0)
    both = known & ~np.isnan(importance) & ~np.isnan(impact)
    n = both.sum(axis=1)

    def centred(v: np.ndarray) -> np.ndarray:
        v = np.where(both, v, 0.0)
        return np.where(both, v - v.sum(axis=1, keepdims=True) / np.maximum(n, 1)[:, None], 0.0)

    a, b = centred(importance), centred(impact)
    size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    r = np.divide((a * b).sum(axis=1), size, out=np.full(len(a), np.nan), where=size > 0)
    top = lambda v: np.max(np.where(known, v, 0.0), axis=1, initial=0.0)
    flat = (top(importance) == 0) | (top(impact) == 0) | (n < 2)
    return aufc, np.where(flat, 0.0, r)


def fidelity_of(
    explained: DataFrame, scorer, stats: dict[str, list[float]], strategy: str = "mean", space: str = "p"
) -> Column:
    """Struct ``n, aufc, correlation`` of each row from its ``x`` and ``phi``, folded in the task that holds it.

    ``n`` counts the explained features; ``random`` reads the ``donor`` of the row.
    """
    each = explained.sparkSession.sparkContext.broadcast(replacement_functions(scorer, space)[0])

    @F.arrow_udf("struct<n:int,aufc:double,correlation:double>")
    def folded(x: pa.Array, phi: pa.Array, values: pa.Array) -> pa.Array:
        importance = np.abs(matrix_of(phi))
        ranks = rank_matrix(importance)
        start, after = each.value(matrix_of(x), matrix_of(values))
        aufc, r = fold_impacts(ranks, importance, np.abs(start[:, None] - after))
        count = (ranks > 0).sum(axis=1).astype(np.int32)
        columns = [pa.array(count), pa.array(aufc), pa.array(r, mask=np.isnan(r))]
        return pa.StructArray.from_arrays(columns, ["n", "aufc", "correlation"])

    return folded("x", "phi", replacement_values(strategy, stats))


def analyze_fidelity(
    explained: DataFrame,
    scorer,
    stats: dict[str, list[float]],
    strategy: str = "mean",
    space: str = "p",
    key: str = KEY,
) -> DataFrame:
    """``(id, aufc, correlation)`` of every explained row.

    The same numbers as ``row_fidelity`` of ``feature_impacts``: features are replaced one
    after the other for a whole batch, scored, and only the row's two numbers leave. Tree
    ensembles follow only the rows that a replaced value turns. Only ``random`` needs a join.
    """
    rows = with_donors(explained, key=key) if strategy == "random" else explained
    found = rows.select(key, fidelity_of(explained, scorer, stats, strategy, space).alias("f"))
    return found.where("f.n > 0").select(key, "f.aufc", "f.correlation")
