"""Cleaning: missing rows, duplicates, constant columns, text to numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType

from plumbline.sources.shared import materialize

# The types that are not cast.
KEPT_NUMERIC = (IntegerType, LongType, FloatType, DoubleType)


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without null or NaN."""
    return df.na.drop()


def drop_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Distinct rows; the key is part of the row unless ``subset`` says otherwise."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def duplicate_report(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row ``(n_rows, n_distinct, n_removed)`` from a single aggregation."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")
    ).select("n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_removed"))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value.

    Smallest = largest is the same test as a distinct count of 1, in one narrow
    pass; a single row of flags reaches the driver, since it decides the schema.
    """
    flags = df.agg(
        *[F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(c) for c in df.columns]
    ).first()
    return [c for c in df.columns if flags[c]]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def cast_text_to_float(df: DataFrame) -> DataFrame:
    """Text columns to float, null where the text is no number.

    Types that no cast to float exists for (dates, timestamps) stay as they are.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    other = {
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, KEPT_NUMERIC)
        and f.dataType.typeName() in ("byte", "short", "decimal", "boolean")
    }
    return df.select(
        *[
            F.col(f"`{c}`").try_cast("float").alias(c)
            if c in text
            else F.col(f"`{c}`").cast("float").alias(c)
            if c in other
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def clean(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """The four steps in order.

    Removing whole-row duplicates cannot change which columns are constant, so that
    test reads the rows before the shuffle and the duplicates are dropped once, from
    the narrower table. Constant columns cannot tell two rows apart. With a
    ``subset`` rows that differ elsewhere go too, so duplicates are dropped first.
    """
    complete = drop_missing(df)
    if subset:
        return cast_text_to_float(drop_constant(materialize(drop_duplicates(complete, subset), "distinct")))
    return cast_text_to_float(drop_duplicates(drop_constant(complete), subset))
