"""Compare a Spark result with a DuckDB result: names, types, row count and values."""

from __future__ import annotations

import os
from glob import glob

import duckdb
import pandas as pd

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark_df, relation) -> str | None:
    """None if equal, else a short account of the first difference."""
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} vs {sorted(relation.columns)}"
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types)))
    for f in spark_df.schema.fields:
        want = TYPES.get(f.dataType.simpleString())
        if want != theirs[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {theirs[f.name]}"
    a = spark_df.toPandas()[names]
    b = relation.df()[names]
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = (_ordered(x) for x in (a, b))
    for n in names:
        left, right = a[n], b[n]
        same = (left == right) | (left.isna() & right.isna())
        if not same.all():
            i = int((~same).to_numpy().argmax())
            return f"{n}: {int((~same).sum())} values differ, first {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return None


def _ordered(df: pd.DataFrame) -> pd.DataFrame:
    text = [c for c in df.columns if df[c].dtype == object]
    first = [c for c in ("id", "rep", "k", "rank", "feature_pos", *text) if c in df.columns]
    order = list(dict.fromkeys([*first, *df.columns]))
    return df.sort_values(order, na_position="first").reset_index(drop=True)
