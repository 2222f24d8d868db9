"""Near-duplicate vectors by p-stable hashing for Euclidean distance and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import bytetext
from plumbline.llm.components import connected_components
from plumbline.llm.jaccard import _spanning
from plumbline.llm.storing import store
from plumbline.llm.streams import matrix, whole_groups
from plumbline.llm.vectors import doubles

WIDTH = 2.0
BLOCK = 512
CELL_BYTES = 8_000_000
SEED = 20_240_607


def collision(distance: float, width: float) -> float:
    """Chance that a quantised Gaussian projection puts two points at a distance in one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Hashes:
    """``tables`` keys of ``bits`` quantised projections each."""

    bits: int
    tables: int
    width: float = WIDTH
    seed: int = SEED

    @classmethod
    def plan(cls, n: int, cosine: float, recall: float) -> Hashes:
        """Few unrelated vectors a bucket, and ``recall`` for pairs at ``cosine`` exactly.

        Unrelated vectors are at right angles. Higher cosines are found more surely.
        """
        near, far = collision(math.sqrt(2 - 2 * cosine), WIDTH), collision(math.sqrt(2), WIDTH)
        bits = max(1, math.ceil(math.log(max(2, 4 * n)) / -math.log(far)))
        return cls(bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**bits))))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket keys, a row for each vector and a column for each table."""
        dim = unit.shape[1]
        rng = np.random.default_rng([self.seed, dim])
        planes = rng.standard_normal((dim, self.tables * self.bits))
        shift = rng.uniform(0, self.width, self.tables * self.bits)
        cells = np.floor((unit @ planes + shift) / self.width).astype(np.int64).view(np.uint64)
        key = np.full((len(unit), self.tables), dim, np.uint64)
        for b in range(self.bits):
            key = bytetext.mix(key, 3) + cells[:, b :: self.bits]
        return bytetext.signed(bytetext.mix(key, 5))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True) if len(vectors) else vectors
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)) if len(vectors) else vectors


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each length that occurs."""
    lengths = np.diff(column.offsets.to_numpy())
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, unit_rows(matrix(column.take(pa.array(rows))))


def bucket(hashes: Hashes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for rows, unit in _by_length(batch.column(1)):
                keys = hashes.keys(unit)
                tables = np.broadcast_to(np.arange(hashes.tables, dtype=np.int32), keys.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tables.ravel()), pa.array(keys.ravel()), pa.array(np.repeat(uid[rows], hashes.tables))], ["t", "k", "uid"]
                )

    return run


def compare(hashes: Hashes, cosine: float) -> Callable:
    """Cells of a bucket's blocks to link counts of vectors and links that span the cell.

    A pair that meets in several tables is counted in the first of them only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in whole_groups(batches, ["t", "k", "i", "j"], CELL_BYTES):
            uid, copies, t, i, j, own = (table.column(c).to_numpy() for c in ("uid", "copies", "t", "i", "j", "own"))
            vectors = table.column("vector").combine_chunks()
            found: list[tuple[int, int, int]] = []
            bounds = np.append(np.flatnonzero(np.append(True, np.diff(cells) != 0)), len(cells))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                unit = unit_rows(matrix(vectors.slice(a, b - a)))
                links = unit @ unit.T >= cosine
                links &= own[a:b, None] <= own[None, a:b]
                if i[a] != j[a]:
                    links &= own[a:b, None] != own[None, a:b]
                    links |= links.T
                np.fill_diagonal(links, False)
                rows = np.flatnonzero(links.any(axis=1))
                if not len(rows):
                    continue
                links = links[np.ix_(rows, rows)]
                if t[a]:
                    keys = hashes.keys(unit[rows])[:, : t[a]]
                    for e in range(t[a]):
                        links &= keys[:, e][:, None] != keys[:, e][None, :]
                names = uid[a:b][rows]
                counts = links @ copies[a:b][rows]
                found += [(int(u), int(u), int(c)) for u, c in zip(names, counts, strict=True) if c]
                found += [(int(names[x]), int(names[y]), 0) for x, y in _spanning(links)]
            columns = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "links"])

    return run


def near_duplicates(
    df: DataFrame, cosine: float = 0.95, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, by links of at least ``cosine``.

    Equal vectors are one node with a count. Nodes are hashed in several tables by
    projections on Gaussian vectors, quantised; those that share a bucket are compared
    in doubles. Every table takes all rows; more rows mean longer keys and more tables.
    A bucket of more than ``BLOCK`` nodes is compared block by block in many tasks, and
    only counts and spanning links are emitted.

    Links at ``cosine`` are found with a chance of ``recall`` each, closer ones more
    surely; none below it is returned. A vector that is null, empty, zero, or holds a
    null or non-finite component links with nothing, and so do vectors of different
    length. Repeated rows are linked. An empty table gives no rows. Only the two
    columns are read.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = doubles(df, key, vector)
    nodes = store(good.groupBy("vector").agg(F.min("vec_id").alias("uid"), F.count("*").alias("copies")).where("uid IS NOT NULL"), "vectors")
    hashes = Hashes.plan(max(1, nodes.count()), cosine, recall)
    keyed = store(nodes.select("uid", "vector").mapInArrow(bucket(hashes), "t int, k long, uid long"), "keys")
    shared = keyed.groupBy("t", "k").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("uid", "t"), F.col("blocks")).cast("int")
    cells = (
        keyed.join(shared, ["t", "k"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid")
    )
    place = ["t", "k", "i", "j"]
    shipped = cells.join(nodes, "uid").repartition(*place).sortWithinPartitions(*place)
    met = store(shipped.mapInArrow(compare(hashes, cosine), "x long, y long, links long"), "met")
    counts = met.where("links > 0").groupBy(F.col("x").alias("uid")).agg(F.sum("links").alias("links"))
    comp = connected_components(met.where("links = 0"), "x", "y")
    known = (
        nodes.join(counts, "uid", "left")
        .join(comp.withColumnRenamed("node", "uid"), "uid", "left")
        .select("vector", F.coalesce("component", "uid").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(known, "vector", "left").select(
        F.col("vec_id").alias(key),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
