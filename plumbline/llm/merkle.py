"""Merkle manifest of a dataset: hash trees over the records of each group and over the groups.

A tree is rolled up by grouping away one rank digit after the other inside blocks of
``FAN ** DIGITS`` neighbours, each parent holding its children as an array of structs.
The roots of the blocks are rolled up in the same way until a group has one block.
Proofs come back down: the path above a block is put beside its nested struct by one
grouping, and the struct is exploded level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.ranks import with_rank
from plumbline.llm.storing import store

FAN = 16
DIGITS = 3
STEPS = "array<struct<before:string,after:string>>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbouring fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return sha256(*[field(f) for f in fields])


def _digit(rank: str, k: int) -> Column:
    return F.pmod(F.floor(F.col(rank) / FAN**k), F.lit(FAN)).cast("int")


def roll_blocks(nodes: DataFrame) -> DataFrame:
    """``_group, _block, node`` from ``_group, _rank, node``; one shuffle for all digits.

    A node is a struct of ``full``, its hash, ``alone``, its hash if it is all there is
    at its level in its group (null where that is the same), and what it holds.
    """
    digits = [f"_d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "_group",
        F.floor(F.col("_rank") / FAN**DIGITS).cast("long").alias("_block"),
        *[_digit("_rank", k).alias(d) for k, d in enumerate(digits)],
        "node",
    ).repartition("_group", "_block")
    for k, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("at"), "node")))
        rows = rows.groupBy("_group", "_block", *digits[k + 1 :]).agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
        only = F.col("kids")[0]
        node = F.struct(
            F.sha2(F.array_join(F.transform("kids", lambda x: x["full"]), ""), 256).alias("full"),
            F.when(F.size("kids") == 1, F.coalesce(only["alone"], only["full"])).alias("alone"),
            "kids",
        )
        rows = rows.withColumn("node", node).drop("kids")
    return rows


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Stored blocks of each round, the last with one block a group."""
    rounds = []
    while True:
        rounds.append(store(roll_blocks(nodes), "blocks"))
        if not rounds[-1].agg(F.max("_block")).first()[0]:
            return rounds
        roots = F.struct("node.full", "node.alone").alias("node")
        nodes = rounds[-1].select("_group", F.col("_block").alias("_rank"), roots)


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``_group, root`` of a climbed tree."""
    return rounds[-1].select("_group", F.coalesce("node.alone", "node.full").alias("root"))


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """One row a leaf: ``_group, _block, leaf, steps`` and the ``carry`` of its group.

    ``above`` has ``_group, steps, carry``: the path over each group's root and whatever
    its leaves shall carry. A step holds the hashes before and after a node among its
    siblings; the first step is the leaf's. A node that is all there is at its level
    has no step. Blocks and paths meet in one grouping, and nothing is joined.
    """
    above = above.select("_group", F.lit(0).cast("long").alias("_block"), F.struct("steps", F.lit(True).alias("sole"), "carry").alias("top"))
    for blocks in reversed(rounds):
        node_type, top_type = blocks.schema["node"].dataType, above.schema["top"].dataType
        both = blocks.withColumn("top", F.lit(None).cast(top_type)).unionByName(above.withColumn("node", F.lit(None).cast(node_type)))
        met = both.groupBy("_group", "_block").agg(F.first("node", True).alias("node"), F.first("top", True).alias("top"))
        rows = met.select("_group", "_block", "node", "top.steps", "top.sole", "top.carry")
        for _ in range(DIGITS):
            hashes = F.transform("node.kids", lambda x: x["full"]).alias("hashes")
            rows = rows.select("_group", "_block", "steps", "sole", "carry", hashes, F.posexplode("node.kids").alias("at", "node"))
            n = F.size("hashes")
            before = F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "")
            after = F.array_join(F.slice("hashes", F.col("at") + 2, n - F.col("at") - 1), "")
            sole = F.col("sole") & (n == 1)
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            rows = rows.select(
                "_group",
                (F.col("_block") * FAN + F.col("at")).alias("_block"),
                "node",
                F.when(sole, F.col("steps")).otherwise(F.concat(step, F.col("steps"))).alias("steps"),
                sole.alias("sole"),
                "carry",
            )
        above = rows.select("_group", "_block", F.struct("steps", "sole", "carry").alias("top"))
    return rows.select("_group", F.col("node").alias("leaf"), "steps", "carry")


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, payload: list[str] = []) -> DataFrame:
    """Root of the dataset, root of each group, and a proof for every record.

    Columns: ``group, key, leaf, payload..., steps, subroot, root`` under the names given
    for the first ones. Records of a group ascend by key (null first; equal keys by
    leaf hash, so the root does not depend on how the table is stored). While a group
    has several nodes, every ``FAN`` consecutive ones become the hash of their hashes;
    the last may be fewer. The groups' roots, in order of the group (null first, as
    bytes), become one root in the same way. ``steps`` leads from the leaf to the root:
    hashing ``before``, the hash so far and ``after`` for each step gives the root.

    A null group is a group, null keys are keys; a lone leaf is its group's root, a
    lone group's root the root. Repeated rows each have a leaf. An empty table gives
    no rows. Only the named columns are read, so other names cannot clash. A group
    with a third of all rows lies in as many blocks as it needs; a task holds one block
    at a time. Every round of roots is written to the shared folder.
    """
    held = F.struct(F.col(key).alias("key"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)])
    rows = leaves.select(F.col(group).alias("_group"), held.alias("_held"), F.col(leaf).alias("_leaf"))
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.col("_held.key")), "leaves")
    none = F.lit(None).cast("string").alias("alone")
    node = F.struct(F.col("_leaf").alias("full"), none, F.col("_held").alias("held")).alias("node")
    trees = climb(with_rank(rows, "_group", ["_key", "_leaf", "_row"]).select("_group", "_rank", node))

    tops = roots(trees).select(F.lit(0).alias("_all"), F.col("_group").alias("_name"), F.col("root").alias("_root"))
    node = F.struct(F.col("_root").alias("full"), none, F.col("_name").alias("name")).alias("node")
    top = climb(with_rank(tops, "_all", ["_name"]).select(F.col("_all").alias("_group"), "_rank", node))

    start = roots(top).select("_group", F.array().cast(STEPS).alias("steps"), F.struct("root").alias("carry"))
    paths = descend(top, start).select(
        F.col("leaf.name").alias("_group"), "steps", F.struct(F.col("leaf.full").alias("subroot"), "carry.root").alias("carry")
    )
    return descend(trees, paths).select(
        F.col("_group").alias(group),
        F.col("leaf.held.key").alias(key),
        F.col("leaf.full").alias(leaf),
        *[F.col(f"leaf.held.p{i}").alias(p) for i, p in enumerate(payload)],
        "steps",
        "carry.subroot",
        "carry.root",
    )


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings on the way up, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf hash and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: sha256(s["before"], h, s["after"]))
