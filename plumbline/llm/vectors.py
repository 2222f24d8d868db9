"""Distinct usable vectors of an embedding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def doubles(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vector`` (array<double>) of the usable rows."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(usable(F.col("vector")))
