"""Positions of rows within ordered groups, a group of any size spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from plumbline.llm.storing import store


def run_counter(group: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add to sorted rows the partition, the number of the run of equal ``group`` there, and the place in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, nth, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(group)
            codes = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh = np.ones(n, bool)
            fresh[1:] = codes[1:] != codes[:-1]
            fresh[0] = run < 0 or values[0].as_py() != last
            at = np.arange(n, dtype=np.int64)
            first = np.maximum.accumulate(np.where(fresh, at, -1))
            place = np.where(first < 0, at + nth, at - first)
            runs = run + np.cumsum(fresh)
            run, nth, last = int(runs[-1]), int(place[-1]) + 1, values[n - 1].as_py()
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_run", "_nth"])

    return count


def with_rank(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank``: the place from 0 within ``group`` in ascending ``order``, nulls first.

    ``group`` and ``order`` together must tell rows apart where their order matters. Rows
    are sorted by range, so a group of any size spans as many partitions as it needs,
    and numbered within a partition. Only the first run of a partition can go on from
    earlier ones, so the shifts are one number a partition, which is what is broadcast.
    """
    schema = StructType([*rows.schema.fields]).add("_part", IntegerType()).add("_run", LongType()).add("_nth", LongType())
    keys = list(dict.fromkeys([group, *order]))
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = store(spread.mapInArrow(run_counter(group), schema), "placed")
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(group, "_part")
        .agg(F.count("*").alias("n"))
        .select("_part", F.sum("n").over(earlier).alias("_shift"))
        .where("_shift > 0")
        .withColumn("_run", F.lit(0).cast("long"))
    )
    return placed.join(F.broadcast(shifts), ["_part", "_run"], "left").select(
        *rows.columns, (F.col("_nth") + F.coalesce("_shift", F.lit(0))).alias("_rank")
    )
