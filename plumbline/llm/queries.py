"""One query an operator, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm import (
    embedding_dedup,
    filter_audit,
    jaccard,
    language_id,
    lm_scoring,
    merkle,
    packing,
    piece_coding,
    prefix_forest,
    repeats,
    sharding,
    token_files,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 40
TOKENIZERS = os.environ.get("TOKENIZERS_DIR") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document, by its key alone."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign(docs, [1.0] * SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page. The tables label documents, so page and document numbers are matched."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.judge(table(spark, sf_dir, "pages"), labels, RULES)
    bounds = [F.round(c, 6).alias(c) for c in ("good_share", "lower", "upper")]
    return judged.select("page_id", "host", "path", "rule", "verdict", *bounds)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; a checksum for the ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard of 0.9 on three-word shingles, as components."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked at a cosine of 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def remainder(key: str, of: int) -> Column:
    """crc32 of a key written as text, modulo ``of``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of six sevenths of them."""
    held_out = remainder("doc_id", 7) == 2
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network trained on two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    net = language_id.fit(docs, ~held_out)
    labelled = language_id.label(docs.select("doc_id", "text"), net)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it (the space mark to a space)."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = piece_coding.decode(piece_coding.encode(docs, model), model)
    same = F.col("decoded") == F.replace("text", F.lit(piece_coding.MARK), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; a fifth is tampered with by lower-casing and must not verify."""
    docs = table(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(
        "doc_id",
        "source",
        merkle.leaf_hash([*others, F.col("text")]).alias("leaf"),
        F.when(chosen, merkle.leaf_hash([*others, F.translate("text", capitals, capitals.lower())])).alias("tampered"),
    )
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf", ["tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters of documents in all 120 orders: what each step keeps, removes and costs in labels."""
    labels = table(spark, sf_dir, "labels")
    filters = {
        "A": lambda m: m.where("n_words < 100"),
        "B": lambda m: m.where("100 * n_distinct < 80 * n_words"),
        "C": lambda m: m.where("100 * n_capitals > 10 * n_points"),
        "D": lambda m: m.where("marked"),
        "E": filter_audit.copies,
    }
    losses = {
        "good_lost": labels.where("quality = 1").select("doc_id"),
        "toxic_lost": labels.where("toxic = 1").select("doc_id"),
    }
    return filter_audit.audit_texts(table(spark, sf_dir, "documents"), filters, losses)


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of token ids in order of doc_id, and read back."""
    docs = table(spark, sf_dir, "documents")
    corpus, index = token_files.write(docs, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    back = token_files.read(spark, corpus, index)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
