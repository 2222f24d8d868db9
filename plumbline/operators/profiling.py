"""Profiles of a table as DataFrames; no row of the table reaches the driver."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StructType

from plumbline.functions.arrays import (
    KEY,
    LABEL,
    literal_names,
    numeric_columns,
    unpivot_columns,
)
from plumbline.functions.guards import drop_nan
from plumbline.operators.quantiles import exact_quantiles

SHARE_DIGITS = 9
MOMENT_BLOCK = 512
GRID_BYTES = 64_000_000
MOST_LABELS = 1000


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _numeric(df: DataFrame, columns: list[str] | None) -> list[str]:
    return numeric_columns(df) if columns is None else columns


def schema_report(df: DataFrame) -> DataFrame:
    """``(pos, column, type, nullable)``, one row for each column."""
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "pos int, column string, type string, nullable boolean"
    )


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).count()


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n, mean, stddev, min, max)`` of numeric columns; NaN counts as missing.

    Cells are aggregated by column name in the map tasks: the generated code
    stays small and compiled for any number of columns, and one row per column
    and task is shuffled.
    """
    cells = unpivot_columns(df, _numeric(df, columns), [])
    value = drop_nan(F.col("value"))
    return cells.groupBy("column").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def quartiles(
    df: DataFrame, columns: list[str] | None = None, probs: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(column, prob, n, quantile)``, exact and interpolated."""
    columns = _numeric(df, columns)
    return exact_quantiles(unpivot_columns(df, columns, []), ["column"], "value", list(probs))


def describe_with_quartiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wide = (
        quartiles(df, columns)
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("q50"),
            F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q75"),
        )
    )
    return describe(df, columns).join(F.broadcast(wide), "column", "left")


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, n_missing)``: null, or NaN in a floating column."""
    wide = df.agg(*[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def _text_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(entries))


def _typed_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, f, i, s)``: each cell in the slot of its kind, so no number is printed as text."""

    def cell(c: str) -> Column:
        kind, value = df.schema[c].dataType, F.col(f"`{c}`")
        floating = isinstance(kind, (DoubleType, FloatType))
        whole = isinstance(kind, IntegralType)
        slot = [
            value.cast("double") if floating else F.lit(None).cast("double"),
            value.cast("bigint") if whole else F.lit(None).cast("bigint"),
            F.lit(None).cast("string") if floating or whole else value.cast("string"),
        ]
        return F.struct(F.lit(c).alias("column"), *[v.alias(n) for v, n in zip(slot, "fis")])

    return df.select(F.inline(F.array(*[cell(c) for c in columns])))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n_distinct)``, exact; null is no value, NaN is one.

    Cells are grouped before they are counted: every value is shuffled once per
    map task however often it occurs, and no row is expanded into a separate
    aggregate for each column.
    """
    cells = _typed_cells(df, columns or df.columns).groupBy("column", "f", "i", "s")
    known = F.col("f").isNotNull() | F.col("i").isNotNull() | F.col("s").isNotNull()
    return (
        cells.agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count_if(known).alias("n_distinct"))
    )


def order_by_count(df: DataFrame, column: str) -> DataFrame:
    """``(column, count)`` by falling count, equal counts by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def approx_distinct_counts(
    df: DataFrame, columns: list[str] | None = None, log_buckets: int = 12
) -> DataFrame:
    """``(column, n_distinct)`` by one sketch per column: one pass, no large shuffle."""
    columns = columns or df.columns
    wide = df.agg(
        *[
            F.hll_sketch_estimate(
                F.hll_sketch_agg(F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")), log_buckets)
            ).alias(f"n{i}")
            for i, c in enumerate(columns)
        ]
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_distinct"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def value_distribution(df: DataFrame, max_values: int = 20) -> DataFrame:
    """``(column, value, count)`` of columns with at most ``max_values`` values, null included.

    A sketch first rules out columns with clearly more values, so that key-like columns
    are never printed or shuffled; the limit itself is applied to exact counts. The
    sketch lists up to hundreds of values one by one before it estimates, so no column
    within the limit can reach twice of it. One row for each column is collected.
    """
    sketch = approx_distinct_counts(df).where(F.col("n_distinct") <= 2 * max_values + 8)
    names = {r["column"] for r in sketch.select("column").collect()}
    counts = _text_rows(df, [c for c in df.columns if c in names]).groupBy("column", "value").count()
    few = counts.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= max_values)
    return counts.join(F.broadcast(few.select("column")), "column", "left_semi").orderBy(
        "column", F.desc("count"), "value"
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col_a, col_b, r)`` from Spark ML's matrix; for wide tables without missing values."""
    spark = df.sparkSession
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    matrix = Correlation.corr(vectors.select("features"), "features", "pearson").first()[0]
    cells = matrix.toArray()
    rows = [
        (a, b, None if cells[i, j] != cells[i, j] else float(cells[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return spark.createDataFrame(rows, "col_a string, col_b string, r double")


def column_tiles(n: int, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All unordered pairs of ``n`` columns, as pairs of blocks of at most ``block`` columns."""
    blocks = [np.arange(lo, min(lo + block, n)) for lo in range(0, n, block)]
    return [(a, b) for i, a in enumerate(blocks) for b in blocks[i:]]


def _doubles(df: DataFrame, columns: list[str], positions: np.ndarray, *keep: str) -> DataFrame:
    """The columns at some positions as doubles, named by position."""
    return df.select(*keep, *[F.col(f"`{columns[i]}`").cast("double").alias(f"_{i}") for i in positions])


def pairwise_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(col_a, col_b, r)`` for every unordered pair, over the rows complete in both columns.

    Each task folds its rows into one set of co-moments by matrix products and
    emits a row per pair; the sums over tasks and the coefficient are a grouped
    aggregate. Columns are taken in tiles of ``MOMENT_BLOCK`` by as many, each of which reads its own
    columns only, so a task holds the moments of one tile. Values are taken relative to
    the column's mean, held within its range so that a constant column is exactly 0.
    Null where undefined.
    """
    columns = _numeric(df, columns)
    limits = {r["column"]: r for r in describe(df, columns).collect()}
    shift = np.array([_centre(limits.get(c)) for c in columns])
    sums = ["n", "a", "b", "ab", "aa", "bb"]
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in sums)

    def folder(left: np.ndarray, right: np.ndarray):
        first, second = (m.ravel() for m in np.meshgrid(left, right, indexing="ij"))
        ordered = first < second
        places = np.unique(np.concatenate([left, right]))
        at, to = np.searchsorted(places, left), np.searchsorted(places, right)

        def fold(batches):
            total = 0.0
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift[places]
                known = ~np.isnan(x)
                x, known = np.where(known, x, 0.0), known.astype(float)
                xa, xb, ka, kb = x[:, at], x[:, to], known[:, at], known[:, to]
                moments = [ka.T @ kb, xa.T @ kb, ka.T @ xb, xa.T @ xb, (xa * xa).T @ kb, ka.T @ (xb * xb)]
                total = total + np.stack(moments)
            if np.ndim(total):
                cells = [m.ravel()[ordered] for m in total]
                pairs = [v[ordered].astype(np.int32) for v in (first, second)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*pairs, *cells)], ["i", "j", *sums])

        return _doubles(df, columns, places).mapInArrow(fold, schema)

    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    parts = [folder(left, right) for left, right in column_tiles(len(columns), MOMENT_BLOCK)]
    folded = reduce(DataFrame.unionByName, parts)
    totals = folded.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n, a, b, ab, aa, bb = (F.col(s) for s in sums)
    spread_a, spread_b = aa - F.try_divide(a * a, n), bb - F.try_divide(b * b, n)
    r = F.try_divide(ab - F.try_divide(a * b, n), F.sqrt(spread_a) * F.sqrt(spread_b))
    return totals.select(
        literal_names(columns)[F.col("i")].alias("col_a"),
        literal_names(columns)[F.col("j")].alias("col_b"),
        F.when((n > 1) & ~F.isnan(r), r).alias("r"),
    )


def _centre(limits) -> float:
    if limits is None or limits["mean"] is None:
        return 0.0
    return min(max(limits["mean"], limits["min"]), limits["max"])


def strong_correlations(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 0.5
) -> DataFrame:
    return pairwise_correlation(df, columns).where(F.abs("r") >= threshold)


def bucket(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bucket from 0; the last one is closed, a constant falls into bucket 0.

    The share of the width is rounded to ``SHARE_DIGITS`` digits first, so that a value
    on an edge falls into the bucket above it whatever its last bits are.
    """
    share = F.round(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)), SHARE_DIGITS)
    return F.least(F.floor(F.round(share * bins, SHARE_DIGITS - 3)), F.lit(bins - 1)).cast("int")


def histograms(
    long: DataFrame, by: str, groups: list[str], bins: int, value: str = "value"
) -> DataFrame:
    """``(by, groups…, bucket, n)``: equal-width counts between each ``by`` group's own limits."""
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    limits = rows.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    placed = rows.join(F.broadcast(limits), by).select(
        by, *groups, bucket(F.col(value), F.col("low"), F.col("high"), bins).alias("bucket")
    )
    return placed.groupBy(by, *groups, "bucket").agg(F.count("*").alias("n"))


def histogram_by_class(
    df: DataFrame, columns: list[str] | None = None, label: str = LABEL, bins: int = 20
) -> DataFrame:
    columns = [c for c in _numeric(df, columns) if c != label]
    return histograms(unpivot_columns(df, columns, [label]), "column", [label], bins)


def box_by_class(
    df: DataFrame, columns: list[str] | None = None, label: str = LABEL, reach: float = 1.5
) -> DataFrame:
    """``(column, label, q25, q50, q75, whisker_low, whisker_high, n_outliers)``."""
    columns = [c for c in _numeric(df, columns) if c != label]
    long = unpivot_columns(df, columns, [label])
    by = ["column", label]
    boxes = (
        exact_quantiles(long, by, "value", [0.25, 0.5, 0.75])
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("q50"),
            F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q75"),
        )
    )
    spread = reach * (F.col("q75") - F.col("q25"))
    inside = F.col("value").between(F.col("q25") - spread, F.col("q75") + spread)
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(boxes), by)
    return rows.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def outlier_counts(
    df: DataFrame, columns: list[str] | None = None, label: str = LABEL, reach: float = 1.5
) -> DataFrame:
    """``(column, n_outliers)``: rows outside their class's fences."""
    boxes = box_by_class(df, columns, label, reach)
    return boxes.groupBy("column").agg(F.sum("n_outliers").alias("n_outliers"))


def few_labels(df: DataFrame, label: str) -> int:
    """How many values the label has; a column that is no label is refused by its name."""
    n = df.select(label).where(F.col(label).isNotNull()).distinct().limit(MOST_LABELS + 1).count()
    if n > MOST_LABELS:
        raise ValueError(f"{label!r} has more than {MOST_LABELS} values; a label is wanted")
    return n


def scatter_bins(
    df: DataFrame, columns: list[str] | None = None, label: str = LABEL, bins: int = 10
) -> DataFrame:
    """``(col_a, col_b, label, bin_a, bin_b, n)`` for every column pair.

    Each task counts its rows into one grid per pair and label and emits the
    occupied cells; a grouped sum adds the tasks up. Columns are taken in tiles, each of which reads
    its own columns only: a task holds the grids of one tile, at most ``GRID_BYTES``,
    whatever the number of columns and labels. Size depends on columns and bins, not on rows.
    """
    columns = [c for c in _numeric(df, columns) if c != label]
    found = {r["column"]: r for r in describe(df, columns).collect()}
    low = np.array([np.nan if found[c]["min"] is None else found[c]["min"] for c in columns])
    high = np.array([np.nan if found[c]["max"] is None else found[c]["max"] for c in columns])
    cells = bins * bins
    block = max(1, int((GRID_BYTES / (8 * cells * max(1, few_labels(df, label)))) ** 0.5))
    group_type = to_arrow_type(df.schema[label].dataType)
    schema = StructType([df.schema[label]])
    for name, kind in (("i", "integer"), ("j", "integer"), ("cell", "integer"), ("n", "long")):
        schema = schema.add(name, kind)

    def folder(left: np.ndarray, right: np.ndarray):
        places = np.unique(np.concatenate([left, right]))
        pairs = [(i, j) for i in left for j in right if i < j]
        first, second = np.array(pairs, np.int32).reshape(-1, 2).T

        def fold(batches):
            grids = {}
            least, most = low[places], high[places]
            at, to = np.searchsorted(places, first), np.searchsorted(places, second)
            for batch in batches:
                groups = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                with np.errstate(invalid="ignore", divide="ignore"):
                    step = np.where(most > least, (x - least) / (most - least), np.where(np.isnan(x), x, 0.0))
                known = ~np.isnan(step)
                share = np.round(np.round(np.where(known, step, 0.0), SHARE_DIGITS) * bins, SHARE_DIGITS - 3)
                place = np.minimum(np.floor(share), bins - 1).astype(np.int64)
                for group in np.unique(groups):
                    rows = groups == group
                    grid = grids.setdefault(group, np.zeros((len(first), cells), np.int64))
                    p, k = place[rows].T.copy(), known[rows].T.copy()
                    for pair, (i, j) in enumerate(zip(at, to)):
                        both = k[i] & k[j]
                        grid[pair] += np.bincount((p[i] * bins + p[j])[both], minlength=cells)
            for group, grid in grids.items():
                pair, cell = np.nonzero(grid)
                columns = [pa.array(v) for v in (first[pair], second[pair], cell.astype(np.int32), grid[pair, cell])]
                own = pa.array(np.full(len(pair), group)).cast(group_type)
                yield pa.RecordBatch.from_arrays([own, *columns], schema.names)

        return _doubles(df.where(F.col(label).isNotNull()), columns, places, label).mapInArrow(fold, schema)

    tiles = [t for t in column_tiles(len(columns), block) if len(np.union1d(*t)) > 1]
    if not tiles:
        return df.sparkSession.createDataFrame([], f"col_a string, col_b string, `{label}` {df.schema[label].dataType.simpleString()}, bin_a int, bin_b int, n long")
    counts = reduce(DataFrame.unionByName, [folder(*t) for t in tiles]).groupBy("i", "j", label, "cell").agg(F.sum("n").alias("n"))
    return counts.select(
        literal_names(columns)[F.col("i")].alias("col_a"),
        literal_names(columns)[F.col("j")].alias("col_b"),
        label,
        F.floor(F.col("cell") / bins).cast("int").alias("bin_a"),
        (F.col("cell") % bins).cast("int").alias("bin_b"),
        "n",
    )


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, feature_pos, mean, median, std)``: one small row per feature."""
    base = describe(df, features).select(
        F.col("column").alias("feature"), "mean", F.col("stddev").alias("std")
    )
    medians = quartiles(df, features, (0.5,)).select(
        F.col("column").alias("feature"), F.col("quantile").alias("median")
    )
    position = F.array_position(literal_names(features), F.col("feature")).cast("int")
    return base.join(F.broadcast(medians), "feature", "left").select(
        "feature", position.alias("feature_pos"), "mean", "median", "std"
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Schema, missing and distinct counts side by side, one row for each column."""
    return (
        schema_report(df)
        .join(F.broadcast(missing_counts(df)), "column")
        .join(F.broadcast(distinct_counts(df)), "column")
    )


def assemble(df: DataFrame, features: list[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=to).transform(df)


def disassemble(
    df: DataFrame, features: list[str], column: str = "features", key: str = KEY
) -> DataFrame:
    """Vector column back to one double column per feature."""
    values = vector_to_array(F.col(column))
    return df.select(key, *[values[i].alias(f) for i, f in enumerate(features)])
