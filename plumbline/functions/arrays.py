"""Features and explanations as one array column per row, in feature order.

A row keeps its whole feature vector ``x`` and importance vector ``phi``
together, so ranking, perturbing and comparing are row-local expressions that
need no shuffle. A null entry of ``phi`` means "feature not in the explanation".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

LABEL = "Class"
KEY = "id"


def feature_columns(df: DataFrame, label: str = LABEL, key: str = KEY) -> list[str]:
    """Every column but the label and the key, in table order."""
    return [c for c in df.columns if c not in (label, key)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def vectorize(df: DataFrame, features: list[str], keep: tuple[str, ...] = (KEY, LABEL)) -> DataFrame:
    """``keep`` columns plus ``x``, the features as ``array<double>``."""
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))


def literal_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def literal_names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def replace_at(x: str, pos: str | Column, value: Column) -> Column:
    """``x`` with the entry at 0-based ``pos`` replaced."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.concat(F.slice(x, F.lit(1), pos), F.array(value), F.slice(x, pos + 2, F.size(x)))


def unpivot_array(
    df: DataFrame, column: str, features: list[str], keep: list[str], value: str
) -> DataFrame:
    """Array column to long rows ``(keep…, feature, feature_pos, value)``; positions from 1."""
    rows = df.select(*keep, F.posexplode_outer(column).alias("pos0", value))
    return rows.where(F.col(value).isNotNull()).select(
        *keep,
        literal_names(features)[F.col("pos0")].alias("feature"),
        (F.col("pos0") + 1).alias("feature_pos"),
        value,
    )


def unpivot_columns(
    df: DataFrame, columns: list[str], keep: list[str], name: str = "column", value: str = "value"
) -> DataFrame:
    """Numeric columns to long rows ``(keep…, name, value)`` with double values."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(entries))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows evenly over tasks of a size that adaptive execution chooses.

    For rows read from few files but costly to work on. Large partitions are split
    and small ones merged, down to the cluster's parallelism.
    """
    return df.hint("rebalance", *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """Rows to be joined by a shuffle, whatever their estimated size.

    For exploded or packed rows: the estimate is that of the rows before, without the entries
    of their arrays, and would have a large table collected on the driver and broadcast.
    """
    return df.hint("merge")
