"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.sources.shared import materialize

ROWS_A_SLICE = 100_000
MAX_SLICES = 4096


def _draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's bid for a key: exponential with rate ``weight``; the lowest bid wins."""
    word = F.xxhash64(key, F.lit(shard))
    uniform = (F.shiftrightunsigned(word, 11).cast("double") + 0.5) / float(2**53)
    return -F.log(uniform) / F.lit(float(weight))


def choose_shard(key: Column, weights: list[float]) -> Column:
    """Position of the shard that wins ``key``.

    A bid depends on the key, the shard's position and its weight alone, so one
    more shard at the end takes rows only into itself, and a raised weight takes
    rows only into that shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    bids = [F.struct(_draw(key, i, w).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """A position for every row, gapless from 0 in each shard.

    A shard's rows are dealt by a hash into slices of about ``ROWS_A_SLICE`` rows;
    rows are numbered within a slice and shifted by the slices before it, so no
    task holds a shard. Rows equal in every column of ``order`` are told apart by a
    row number of the stored table, so a key with a third of all rows is dealt too.
    The table of slice sizes has at most shards x ``MAX_SLICES`` rows.
    """
    largest = df.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    slices = max(1, min(MAX_SLICES, -(-largest // ROWS_A_SLICE)))
    dealt = materialize(
        df.withColumn("_row", F.monotonically_increasing_id()).withColumn(
            "_slice", F.pmod(F.xxhash64(*order, "_row"), F.lit(slices)).cast("int")
        ),
        "shards",
    )
    before = W.partitionBy(shard).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, "_slice")
        .count()
        .select(shard, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(shard, "_slice").orderBy(*order, "_row")
    return (
        dealt.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), [shard, "_slice"])
        .withColumn(slot, F.col("_start") + F.col("_nth"))
        .drop("_slice", "_row", "_nth", "_start")
    )


def assign(
    docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard and slot of every record, and the shard with one more of weight 1.

    Columns: the key, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``shard``,
    ``grown_shard``, ``slot``. A null text has size 16 and checksum 0. A null key is
    a key like any other. Repeated rows each keep their slot in the same shard; an
    empty table gives none. Columns of the input are read by name and nothing else
    is carried, so other names cannot clash.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        choose_shard(F.col(key), weights).alias("shard"),
        choose_shard(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["_key", "size", "text_crc32"]).withColumnRenamed("_key", key)
