"""Nearest neighbours by a forest of sorted hash strings, searched by longest prefix.

Each tree gives a vector a string of bits, one for the side of each of its random
planes. A tree is a sorted array of strings, dealt over tasks by their first bits.
A query descends to the strings that share its longest prefix and ascends, in all
trees at once, until enough candidates share the prefix: first the trees only count
the strings at each length, then the length is chosen from the sums, and then the
strings of that prefix are scored. A prefix shorter than a cell's is counted from the
sizes of the cells, and scored in all cells that begin with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.storing import store
from plumbline.llm.streams import by_length, matrix, whole_groups
from plumbline.llm.vectors import doubles

TREES = 40
LEVELS = 24
CELL_ROWS = 16_384
CELL_BYTES = 32_000_000
SCORE_CELLS = 4_000_000
VISITS = 16_384
SEED = 7_654_321
PLACE = ["tree", "cell", "part", "block"]


@dataclass(frozen=True)
class Forest:
    """Planes of all trees; ``cell_bits`` of a string choose the task."""

    dim: int
    trees: int
    cell_bits: int
    largest: float
    seed: int = SEED

    @property
    def bits(self) -> int:
        return self.cell_bits + LEVELS

    def strings(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings as numbers, a row a vector and a column a tree.

        For inner products an indexed vector is lengthened to the largest norm by one
        more component, a query by none; then angles rank as inner products do.
        """
        scaled = vectors / self.largest
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        planes = np.random.default_rng([self.seed, self.dim]).standard_normal((self.dim + 1, self.trees * self.bits))
        sides = np.hstack([scaled, more[:, None]]) @ planes > 0
        out = np.zeros((len(vectors), self.trees), np.int64)
        for b in range(self.bits):
            out = (out << 1) | sides[:, b :: self.bits]
        return out


def spread(forests: list[Forest], query: bool) -> Callable:
    """Vectors to one row for each tree of their length's forest: ``tree, cell, code, uid``."""
    known = {forest.dim: (i, forest) for i, forest in enumerate(forests)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in by_length(batch.column(1)):
                i, forest = known[vectors.shape[1]]
                codes = forest.strings(vectors, query)
                trees = np.broadcast_to(np.arange(forest.trees, dtype=np.int32) + i * forest.trees, codes.shape).ravel()
                uid = np.repeat(batch.column(0).to_numpy()[rows], forest.trees)
                codes = codes.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(codes >> LEVELS), pa.array(codes), pa.array(uid)], ["tree", "cell", "code", "uid"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int]]:
    """``(rows of one cell, rows before the first query)``; a cell's index rows come first."""
    for table, numbers in whole_groups(batches, PLACE, CELL_BYTES):
        bounds = np.append(np.flatnonzero(np.append(True, np.diff(numbers) != 0)), len(numbers))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            cell = table.slice(a, b - a).combine_chunks()
            split = int((cell.column("side").to_numpy() == 0).sum())
            if 0 < split < b - a:
                yield cell, split


def count_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many strings of the cell share each length of prefix with each query."""
    for cell, split in _cells(batches):
        code = cell.column("code").to_numpy()
        index, asked = np.sort(code[:split]), code[split:]
        columns = []
        for shared in range(LEVELS + 1):
            low = asked >> (LEVELS - shared) << (LEVELS - shared)
            columns.append(np.searchsorted(index, low + (1 << (LEVELS - shared))) - np.searchsorted(index, low))
        uid = cell.column("uid").to_numpy()[split:]
        yield pa.RecordBatch.from_arrays([pa.array(uid), *(pa.array(c.astype(np.int64)) for c in columns)], ["uid", *(f"c{s}" for s in range(LEVELS + 1))])


def score(top: int) -> Callable:
    """The best ``top`` of the cell's strings that share each query's prefix, by exact inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, split in _cells(batches):
            code, uid, level = (cell.column(c).to_numpy() for c in ("code", "uid", "level"))
            vectors = matrix(cell.column("vector"))
            order = np.argsort(code[:split], kind="stable")
            index, names, held = code[:split][order], uid[:split][order], vectors[:split][order]
            drop = LEVELS - level[split:]
            low = code[split:] >> drop << drop
            first, last = np.searchsorted(index, low), np.searchsorted(index, low + (1 << drop))
            asked = np.lexsort((last, first))
            bounds = np.append(np.flatnonzero(np.append(True, (np.diff(first[asked]) != 0) | (np.diff(last[asked]) != 0))), len(asked))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                f, e = first[asked[a]], last[asked[a]]
                step = max(1, SCORE_CELLS // max(1, e - f))
                for c in range(a, b, step) if e > f else ():
                    some = asked[c : min(b, c + step)]
                    scores = vectors[split:][some] @ held[f:e].T
                    k = min(top, e - f)
                    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    q, x = np.nonzero(scores >= least[:, None])
                    s = scores[q, x]
                    rank = np.lexsort((names[f:e][x], -s, q))
                    q, x, s = q[rank], x[rank], s[rank]
                    nth = np.arange(len(q)) - np.searchsorted(q, q)
                    keep = nth < top
                    out.append((uid[split:][some[q[keep]]], names[f:e][x[keep]], s[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "uid", "score"])

    return run


def _sized_cells(index: DataFrame) -> DataFrame:
    """``tree, cell, strings, parts`` of the cells that hold strings."""
    sizes = index.groupBy("tree", "cell").agg(F.count("*").alias("strings"))
    return sizes.withColumn("parts", F.ceil(F.col("strings") / CELL_ROWS).cast("int"))


def _outside(query: DataFrame, cells: DataFrame, cell_bits: int) -> DataFrame:
    """``uid, o1, o2, ...``: how many strings share the cell's prefix without its last 1, 2, ... bits, over all trees.

    The cells of queries are few: they are counted once each, then joined to the queries.
    """
    ups = [F.struct(F.lit(t).alias("up"), F.shiftright("cell", t).alias("prefix")) for t in range(1, cell_bits + 1)]
    above = F.explode(F.array(*ups)).alias("_up")
    sums = cells.select("tree", "strings", above).groupBy("tree", "_up").agg(F.sum("strings").alias("strings"))
    asked = query.select("tree", "cell").distinct().select("tree", "cell", above)
    each = [F.coalesce(F.sum(F.when(F.col("_up.up") == t, F.col("strings"))), F.lit(0)).alias(f"o{t}") for t in range(1, cell_bits + 1)]
    counted = asked.join(sums, ["tree", "_up"]).groupBy("tree", "cell").agg(*each)
    return query.join(counted, ["tree", "cell"]).groupBy("uid").agg(*[F.sum(f"o{t}").alias(f"o{t}") for t in range(1, cell_bits + 1)])


def _visits(query: DataFrame, cells: DataFrame, cell_bits: int) -> DataFrame:
    """Queries with their ``level`` in the cells they visit, in all parts of each.

    Below level 0 a query goes to all cells that share its shorter prefix, with a code
    of that cell and level 0, so that it meets all of the cell's strings.
    """
    placed = query.where("level >= 0").join(cells, ["tree", "cell"])
    if cell_bits:
        up = F.explode(F.sequence(F.lit(1), F.lit(cell_bits))).alias("up")
        reached = cells.select("tree", "cell", "parts", up).withColumn("prefix", F.expr("shiftright(cell, up)"))
        away = query.where("level < 0").withColumn("up", -F.col("level")).withColumn("prefix", F.expr("shiftright(cell, up)")).drop("cell")
        code, level = F.shiftleft("cell", LEVELS).alias("code"), F.lit(0).alias("level")
        far = away.join(reached, ["tree", "up", "prefix"]).select("tree", "cell", code, "uid", level, "parts")
        placed = placed.select(far.columns).unionByName(far)
    return placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("tree", "cell", "part", "code", "uid", "level")


def exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner product of each pair, its terms summed in one fixed way."""
    for batch in batches:
        s = np.zeros(batch.num_rows)
        for rows, a in by_length(batch.column("a")):
            b = matrix(batch.column("b").take(pa.array(rows)))
            s[rows] = [math.fsum(x) for x in a * b]
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("uid"), pa.array(s)], ["query", "uid", "score"])


def nearest(
    df: DataFrame,
    is_query: str,
    k: int = 20,
    trees: int = TREES,
    candidates: float = 2.0,
    power: float = 0.9,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` rows of largest inner product found.

    ``is_query`` is an SQL condition on ``vec_id``. All usable rows are indexed, and
    all but the query's own row are candidates. A query ascends until its trees
    together hold ``candidates * n ** power`` strings of ``n``, counted once a tree, and
    at least ``k + 1`` a tree, so that ``k`` rows are found wherever there are as many.
    The more alike the vectors, the fewer do; the defaults are for vectors without any
    structure, where neighbours are hardly nearer than the rest.

    Equal vectors are one node, which carries its ``k + 1`` smallest ids: of any more,
    none can be among the nearest. A cell of more than ``CELL_ROWS`` nodes is dealt in
    parts, each of which the cell's queries visit, ``VISITS`` of them in a task. Ties go to the smaller id. With at
    most ``k`` other rows all are returned. Vectors of different length have no inner
    product: each length has trees and an ``n`` of its own, and a query's candidates are the rows of
    its length. Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part. Repeated rows are candidates each. An empty table gives no rows. Only the
    two columns are read.
    """
    good = doubles(df, key, vector).where("vec_id IS NOT NULL")
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copies = W.partitionBy("vector").orderBy("vec_id")
    nodes = store(
        good.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1)
        .groupBy("vector").agg(F.min("vec_id").alias("uid"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "nodes",
    )
    asked = store(good.where(is_query).groupBy("vector").agg(F.min("vec_id").alias("first")).join(nodes.select("vector", "uid"), "vector").select("uid", "vector"), "queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    lengths = nodes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("largest")).orderBy("dim").collect()
    if not lengths:
        return empty
    forests = [Forest(r["dim"], trees, max(0, int(math.log2(max(1, r["n"] / CELL_ROWS)))), r["largest"] * (1 + 1e-12)) for r in lengths]
    cell_bits = max(forest.cell_bits for forest in forests)
    most = [float(min(r["n"] * trees, max(trees * (k + 1), candidates * r["n"] ** power))) for r in lengths]
    wanted = F.array(*[F.lit(x) for x in most])[F.col("length")]

    rows = "tree int, cell long, code long, uid long"
    index = nodes.select("uid", "vector").mapInArrow(spread(forests, False), rows)
    query = asked.mapInArrow(spread(forests, True), rows)
    index, query = store(index, "index"), store(query, "asked")
    cells = store(_sized_cells(index), "cells")
    parts = cells.select("tree", "cell", "parts")
    placed_index = index.join(parts, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    placed_query = query.join(parts, ["tree", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def together(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        return both.repartition(*PLACE).sortWithinPartitions(*PLACE, "side")

    none = F.lit(0)

    named = ", ".join(f"c{s} long" for s in range(LEVELS + 1))
    counts = together(placed_index.withColumn("block", none), placed_query.withColumn("block", none)).mapInArrow(count_levels, f"uid long, {named}")
    summed = counts.groupBy("uid").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(LEVELS + 1)])
    length = (F.col("tree") / trees).cast("int").alias("length")
    summed = query.select("uid", length).distinct().join(summed, "uid", "left")
    if cell_bits:
        summed = summed.join(_outside(query, cells, cell_bits), "uid")
    enough = [F.when(F.col(f"c{s}") >= wanted, F.lit(s)) for s in range(LEVELS + 1)]
    enough += [F.when(F.col(f"o{t}") >= wanted, F.lit(-t)) for t in range(1, cell_bits + 1)]
    levels = summed.select("uid", F.greatest(F.lit(-cell_bits), *enough).alias("level"))

    visits = store(_visits(query.join(levels, "uid"), cells, cell_bits), "visits")
    blocks = visits.groupBy(*PLACE[:3]).agg(F.ceil(F.count("*") / VISITS).cast("int").alias("blocks"))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    full_index = placed_index.join(blocks, PLACE[:3]).withColumn("block", block).drop("blocks").withColumn("level", F.lit(0)).join(nodes.select("uid", "vector"), "uid")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    full_query = visits.join(blocks, PLACE[:3]).withColumn("block", own).drop("blocks").join(asked, "uid")
    found = together(full_index, full_query.select(full_index.columns)).mapInArrow(score(k + 1), "query long, uid long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "uid")
    kept = found.groupBy("query", "uid").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    pairs = (
        kept.select("query", "uid")
        .join(nodes.select("uid", F.col("vector").alias("b"), "ids"), "uid")
        .join(asked.select(F.col("uid").alias("query"), F.col("vector").alias("a")), "query")
    )
    scored = store(pairs.select("query", "uid", "a", "b").mapInArrow(exact_scores, "query long, uid long, score double").join(nodes.select("uid", "ids"), "uid"), "scored")
    of_rows = good.where(is_query).join(nodes.select("vector", F.col("uid").alias("query")), "vector").select(F.col("vec_id").alias("query_id"), "query")
    each = of_rows.join(scored, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
