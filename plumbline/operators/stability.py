"""Stability: how alike the explanations of a row and of its noisy copies are.

The original importances travel inside the row while it is copied, perturbed and
explained again, so originals and copies meet without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from plumbline.functions.arrays import KEY, shuffled
from plumbline.functions.hashing import words
from plumbline.functions.vectors import (
    list_array,
    matrix_of,
    moved,
    noise_function,
    similarities,
    similarity_function,
    similarity_names,
    similarity_type,
)

# The sizes of the compared top sets.
TOP_K = (5, 10, 20)
NOISE = ("gaussian", "uniform", "relative")


def perturb_noise(
    df: DataFrame,
    stds: list[float],
    multiplier: float = 0.01,
    repetitions: int = 5,
    strategy: str = "gaussian",
    seed: int = 42,
    key: str = KEY,
) -> DataFrame:
    """Rows ``(…, rep)`` with noise in ``x``, repetitions from 1.

    ``gaussian``: standard deviation ``multiplier * std``; ``uniform``: the same
    deviation from a flat distribution; ``relative``: Gaussian with deviation
    ``multiplier * |x|``.
    """
    if strategy not in NOISE:
        raise ValueError(f"unknown noise: {strategy}; use one of {', '.join(NOISE)}")
    first, second = words(seed, F.col(key), F.col("rep"), "noise")
    copies = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    return copies.withColumn("x", noise_function(strategy, multiplier, stds)("x", first, second))


def pair_stability(
    pairs: DataFrame, top_k: tuple[int, ...] = TOP_K, keep: tuple[str, ...] = (KEY, "rep")
) -> DataFrame:
    """``(keep…, cosine, jaccard_k…)`` of ``phi`` against ``phi_original``."""
    scored = pairs.withColumn("s", similarity_function(top_k)("phi_original", "phi"))
    return scored.select(*keep, "s.*")


def explain_copies(
    explained: DataFrame,
    explainer,
    stds: list[float],
    multiplier: float = 0.01,
    repetitions: int = 5,
    strategy: str = "gaussian",
    seed: int = 42,
    key: str = KEY,
) -> DataFrame:
    """``(id, rep, phi_original, phi)``: all noisy copies explained in one pass."""
    keep = [c for c in (key, "x", "explained_class") if c in explained.columns]
    rows = explained.select(*keep, F.col("phi").alias("phi_original"))
    noisy = perturb_noise(rows, stds, multiplier, repetitions, strategy, seed, key)
    return explainer.explain(noisy).select(key, "rep", "phi_original", "phi")


def mean_stability(pairs: DataFrame, top_k: tuple[int, ...] = TOP_K, key: str = KEY) -> DataFrame:
    """Means over the repetitions of each row."""
    names = ["cosine", *[f"jaccard_{k}" for k in top_k]]
    return pairs.groupBy(key).agg(*[F.avg(c).alias(c) for c in names])


def stability_of(
    explained: DataFrame,
    explainer,
    stds: list[float],
    multiplier: float = 0.01,
    repetitions: int = 5,
    strategy: str = "gaussian",
    top_k: tuple[int, ...] = TOP_K,
    seed: int = 42,
    key: str = KEY,
) -> Column:
    """Struct of the mean similarities of each row's noisy copies to it; no copy leaves the task that holds the row."""
    if strategy not in NOISE:
        raise ValueError(f"unknown noise: {strategy}; use one of {', '.join(NOISE)}")
    given = "explained_class" in explained.columns
    shipped = explained.sparkSession.sparkContext.broadcast((explainer.batch_function(), np.asarray(stds, float)))
    pairs = [words(seed, F.col(key), F.lit(rep), "noise") for rep in range(1, repetitions + 1)]

    @F.arrow_udf(similarity_type(top_k))
    def folded(x: pa.Array, phi: pa.Array, first: pa.Array, second: pa.Array, wanted: pa.Array) -> pa.Array:
        values, original = matrix_of(x), matrix_of(phi)
        explain, deviations = shipped.value
        a, b = (v.flatten().to_numpy().reshape(len(x), repetitions) for v in (first, second))
        classes = wanted.to_numpy(zero_copy_only=False) if given else None
        total = None
        for rep in range(repetitions):
            copy = moved(values, a[:, rep], b[:, rep], strategy, multiplier, deviations)
            parts = np.array(similarities(original, explain(copy, classes), top_k))
            total = parts if total is None else total + parts
        return pa.StructArray.from_arrays([pa.array(p) for p in total / repetitions], similarity_names(top_k))

    wanted = F.col("explained_class") if given else F.lit(0)
    first, second = (F.array(*side) for side in zip(*pairs, strict=True))
    return folded("x", "phi", first, second, wanted)


def analyze_stability(explained: DataFrame, explainer, stds: list[float], key: str = KEY, **settings) -> DataFrame:
    """``(id, cosine, jaccard_5, jaccard_10, jaccard_20)`` of every explained row.

    The same numbers as ``mean_stability`` of ``pair_stability`` of ``explain_copies``.
    ``settings`` are those of ``stability_of``.
    """
    found = stability_of(explained, explainer, stds, key=key, **settings)
    return explained.select(key, found.alias("s")).select(key, "s.*")


def align_explanations(
    original: DataFrame, copies: DataFrame, features: list[str], key: str = KEY
) -> DataFrame:
    """Two sparse long tables to ``(id, rep, phi_original, phi)``, aligned by feature.

    ``original`` is ``(id, feature, phi)``, ``copies`` also has ``rep``. Both
    shrink to one array per explanation, at most one entry per feature, before
    they meet on ``id``; features absent from one side stay null there. Entries that lie
    side by side are packed before they are shuffled, once, by ``id``.
    """
    slots = [f"__{i}" for i in range(len(features))]

    def packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        kept = StructType([df.schema[k] for k in keys])
        schema = kept.add("m", ArrayType(DoubleType())).add("given", LongType())
        runs = df.select(*keys, "feature", "phi").mapInArrow(partial(_runs, keys, features), schema)
        wide = runs.repartition(key).groupBy(*keys).agg(
            F.sum("given").alias("given"), *[F.max(F.col("m")[i]).alias(s) for i, s in enumerate(slots)]
        )
        filled = reduce(Column.__add__, [F.col(s).isNotNull().cast("long") for s in slots], F.lit(0))
        repeated = F.raise_error(F.lit("a feature stands twice in one explanation")).cast("array<double>")
        return wide.select(*keys, F.when(F.col("given") == filled, F.array(*slots)).otherwise(repeated).alias(name))

    return shuffled(packed(copies, [key, "rep"], "phi")).join(
        shuffled(packed(original, [key], "phi_original")), key
    )


def _runs(keys: list[str], features: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring entries of one explanation as one array, with how many entries went into it.

    An explanation that is scattered, or cut by the end of a batch, gives several arrays.
    """
    names = pa.array(features, pa.string())
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, bool)
        starts[0] = True
        for k in keys:
            values = batch.column(k)
            differ = pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, n - 1)), True)
            starts[1:] |= differ.to_numpy(zero_copy_only=False)
        first, run = np.flatnonzero(starts), np.cumsum(starts) - 1
        slot = pc.fill_null(pc.index_in(batch.column("feature"), value_set=names), -1).to_numpy(zero_copy_only=False)
        phi = batch.column("phi")
        used = (slot >= 0) & phi.is_valid().to_numpy(zero_copy_only=False)
        packed, absent = np.zeros((len(first), len(features))), np.ones((len(first), len(features)), bool)
        packed[run[used], slot[used]] = phi.to_numpy(zero_copy_only=False)[used]
        absent[run[used], slot[used]] = False
        columns = [batch.column(k).take(pa.array(first)) for k in keys]
        given = pa.array(np.bincount(run[used], minlength=len(first)), pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, list_array(packed, absent), given], [*keys, "m", "given"])
