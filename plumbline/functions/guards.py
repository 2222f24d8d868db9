"""Arithmetic that stays defined at the edges (zero denominators, constants)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """``num / den``; ``default`` (or null) where the denominator is 0."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; null where it is undefined.

    The built-in ``corr`` divides by zero on a constant column under ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b))
    return F.try_divide(F.covar_samp(a, b), spread)


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def drop_nan(c: Column) -> Column:
    """NaN to null, so that aggregates skip both alike."""
    return F.when(~F.isnan(c), c)
