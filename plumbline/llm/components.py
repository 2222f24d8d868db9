"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.storing import store

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has a link.

    Links are undirected; loops and repeats are dropped. In each round a node hands its
    larger neighbours, then its smaller ones, to the least it knows; rounds end when
    the links stand still as stars, after about the logarithm of the longest chain.
    Minima are pre-aggregated, and a node with very many links is joined to one row,
    so a star with a third of all nodes is split by adaptive execution. Each round is
    written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = store(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "links")
    before = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
