"""Splits and samples drawn from the key, so they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.arrays import KEY, LABEL
from plumbline.functions.hashing import hash_key, uniform
from plumbline.operators.numbering import number_rows
from plumbline.operators.quantiles import exact_quantiles


def with_split(
    df: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = KEY, to: str = "is_train"
) -> DataFrame:
    return df.withColumn(to, uniform(seed, F.col(key), "split") < ratio)


def hash_split(
    df: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a row's side depends on its key and the seed only."""
    marked = with_split(df, ratio, seed, key, "__train")
    return marked.where("__train").drop("__train"), marked.where("NOT __train").drop("__train")


def with_fold(
    df: DataFrame, folds: int = 3, seed: int = 42, key: str = KEY, to: str = "fold"
) -> DataFrame:
    return df.withColumn(to, F.floor(uniform(seed, F.col(key), "fold") * folds).cast("int"))


def with_stratified_split(
    df: DataFrame,
    ratio: float = 0.8,
    seed: int = 42,
    key: str = KEY,
    label: str = LABEL,
    to: str = "is_train",
) -> DataFrame:
    """Exactly ``floor(ratio * n)`` train rows in each class.

    The cut is one exact order statistic of the row hash per class, broadcast
    back as a table with one row per class; no class is sorted in one task.
    """
    hashed = df.withColumn("__h", hash_key(seed, F.col(key), "strata").cast("double"))
    cuts = exact_quantiles(hashed, [label], "__h", [ratio], discrete=True).select(
        label, F.col("quantile").alias("__cut")
    )
    return (
        hashed.join(F.broadcast(cuts), label, "left")
        .withColumn(to, F.col("__h") <= F.coalesce("__cut", F.lit(-1.0)))
        .drop("__h", "__cut")
        .select(*df.columns, to)
    )


def balanced_sample(
    df: DataFrame, n: int = 50, seed: int = 42, key: str = KEY, label: str = LABEL
) -> DataFrame:
    """``n`` rows of each class (all rows of a smaller class), in hash order, for any ``n``."""
    hashed = df.withColumn("__h", hash_key(seed, F.col(key), "balance"))
    return smallest_rows(hashed, n, "__h", label, key).select(*df.columns)


def smallest_rows(df: DataFrame, n: int, hash_column: str, by: str, key: str = KEY) -> DataFrame:
    """The ``n`` rows of each ``by`` with the smallest hash (of 52 bits), ties by key.

    Counts by the hash's magnitude, a few numbers a class that merge in the map tasks,
    give the power of two below which each class still has ``n`` rows: about ``n`` to
    ``2 n`` of them, more only where one key repeats. Only those rows pass the filter; they alone are shuffled
    and numbered, in slices, so neither a class nor the sample is sorted in one task.
    """
    size = F.floor(F.log2(F.col(hash_column) + 1)).cast("int")
    below = F.sum("__c").over(Window.partitionBy(by).orderBy("__size"))
    counts = df.groupBy(by, size.alias("__size")).agg(F.count("*").alias("__c")).withColumn("__below", below)
    bounds = counts.groupBy(by).agg(
        F.coalesce(F.min(F.when(F.col("__below") >= n, F.col("__size"))), F.max("__size")).alias("__bound")
    )
    chosen = df.join(F.broadcast(bounds), by).where(size <= F.col("__bound"))
    widened = F.col(hash_column) * F.pow(F.lit(2.0), 51 - F.col("__bound"))
    ranked = number_rows(chosen.withColumn("__wide", widened), "__wide", "__r", [by], key)
    return ranked.where(F.col("__r") <= n).select(*df.columns)


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def first_rows(df: DataFrame, n: int = 100, key: str = KEY) -> DataFrame:
    """The ``n`` rows with the smallest keys."""
    return df.orderBy(key).limit(n)
