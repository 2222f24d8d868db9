"""Exact quantiles that never sort a whole column in one task.

A mergeable sketch brackets each wanted rank; a second scan counts the rows below the
bracket and groups the few values inside it. A rank that its bracket misses is counted and
its bracket widened until it holds. The values are cut into slices of about equally many
distinct values, and only the slice that holds the rank is sorted. Values are grouped
before the shuffle, so a value that fills a third of the table travels as one row per
map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.sources.shared import materialize

WIDER = 8.0


def rank_error(size: int) -> float:
    """Share of the rows by which a rank of the sketch is off, at most, with 99 % confidence."""
    return 2.296 / size**0.9021


def _target(prob: Column, n: Column, discrete: bool) -> Column:
    """Wanted place from 0, between two rows if it is no whole number; -1 if there is none."""
    return F.floor(prob * n + F.lit(1e-9)) - 1 if discrete else (n - 1) * prob


def _bracketed(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, n, k, value, c)``: counts of the values inside each bracket; a null value counts the rows below."""
    held = brackets.groupBy(*by, "n").agg(F.collect_list(F.struct("k", "low", "high")).alias("b"))
    placed = rows.join(F.broadcast(held), by).select(*by, "n", "v", F.inline("b"))
    inside = placed.where("v <= high").select(*by, "n", "k", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("value"))
    return inside.groupBy(*by, "n", "k", "value").agg(F.count("*").alias("c"))


def _held_counts(rows: DataFrame, by: list[str], probs: list[float], discrete: bool, size: int) -> DataFrame:
    """Bracketed counts of every group and target, each from the first bracket that holds its rank."""
    sketch = F.kll_sketch_agg_double("v", size).alias("sketch")
    sketches = materialize(
        rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch), "sketches"
    )
    margin, parts, missed = 3.0 * rank_error(size), [], None
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "k")])

    def edge(rank: float, beyond: str) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(rank)) if 0.0 < rank < 1.0 else F.col(beyond)

    while True:
        edges = [
            F.struct(F.lit(k).alias("k"), edge(p - margin, "least").alias("low"), edge(p + margin, "most").alias("high"))
            for k, p in enumerate(probs)
        ]
        brackets = sketches.select(*by, "n", F.inline(F.array(*edges)))
        if missed is not None:
            brackets = brackets.join(F.broadcast(missed), same, "left_semi")
        counts = materialize(_bracketed(rows, brackets, by), "bracketed")
        sums = counts.groupBy(*by, "n", "k").agg(
            F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("below"), F.sum("c").alias("upto")
        )
        target = _target(F.array(*[F.lit(float(p)) for p in probs])[F.col("k")], F.col("n"), discrete)
        holds = (target < 0) | ((F.col("below") <= F.floor(target)) & (F.col("upto") > F.ceil(target)))
        missed = materialize(sums.where(~holds).select(*[F.col(c).alias(f"__{c}") for c in (*by, "k")]), "missed")
        if margin >= 1 or missed.isEmpty():
            parts.append(counts)
            return reduce(DataFrame.unionByName, parts)
        parts.append(counts.join(F.broadcast(missed), same, "left_anti"))
        margin *= WIDER


def exact_quantiles(
    long: DataFrame,
    by: list[str],
    value: str,
    probs: list[float],
    discrete: bool = False,
    accuracy: int = 4096,
    slices: int = 64,
) -> DataFrame:
    """Rows ``(by…, prob, n, quantile)``, one for each group and entry of ``probs``.

    Linear interpolation by default. ``discrete`` takes the value at rank
    ``floor(prob * n)`` from 1 instead, with no row where that rank is 0. Null
    and NaN values are skipped. ``by`` must have few groups (columns, classes).

    Each group has one sketch of about ``3 * accuracy`` values, whose ranks are off by
    ``rank_error(accuracy)`` at most with 99 % confidence. Brackets are three times
    that wide on either side. Whether the rank lies inside is counted; where it does not,
    the bracket is made ``WIDER`` times as wide, in the end the whole group. Any
    order of the rows gives the same result.
    """
    rows = long.select(*by, F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    counts = _held_counts(rows, by, probs, discrete, accuracy)

    # Slice the bracketed values evenly; slice -1 stands for the rows below the bracket.
    steps = [F.lit(i / slices) for i in range(1, slices)]
    cuts = counts.groupBy(*by, "k").agg(
        F.percentile_approx("value", F.array(*steps), 20 * slices).alias("cuts")
    )
    below = F.filter("cuts", lambda c: c < F.col("value"))
    sliced = counts.join(F.broadcast(cuts), [*by, "k"]).withColumn(
        "slice", F.when(F.col("value").isNull(), -1).otherwise(F.size(below))
    )

    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("k")]
    target = _target(prob, F.col("n"), discrete)
    lower, upper = F.floor("target"), F.ceil("target")

    def holds(rank):
        return (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)

    totals = sliced.groupBy(*by, "n", "k", "slice").agg(F.sum("c").alias("c"))
    running = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("slice"))
    wanted = (
        totals.withColumn("upto", running)
        .withColumn("prob", prob)
        .withColumn("target", target.cast("double"))
        .where(holds(lower) | holds(upper))
        .select(*by, "k", "slice", "prob", "target", (F.col("upto") - F.col("c")).alias("before"))
    )
    inside = F.sum("c").over(Window.partitionBy(*by, "k", "slice").orderBy("value"))
    ranked = sliced.join(F.broadcast(wanted), [*by, "k", "slice"]).withColumn(
        "upto", inside + F.col("before")
    )
    picked = ranked.groupBy(*by, "prob", "n", "target").agg(
        F.max(F.when(holds(lower), F.col("value"))).alias("v0"),
        F.max(F.when(holds(upper), F.col("value"))).alias("v1"),
    )
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("target") - lower)
    return picked.select(*by, "prob", "n", between.alias("quantile"))
