"""From raw documents to packed sequences: language, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import jaccard, language_id, packing, repeats
from plumbline.llm.queries import TOKENIZERS, remainder, table
from plumbline.llm.storing import store
from plumbline.sources.shipping import ship

LEAST_SCORE = 0.25
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names of this module, and those names by the documents' own.

    Stages work under these names and rename once at the end, so that no column of the
    input, whatever it is called, can clash with one of theirs.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language. Those without a letter go, and those that fit no language.

    The network learns from two thirds of the labelled documents it is given. Repeated
    rows are judged alike, an empty table gives no rows, other columns pass through.
    """
    ship(spark)
    rows, name = private(docs)
    net = language_id.fit(rows, remainder(name["doc_id"], 3) != 1, name["doc_id"], name["text"], name["lang"])
    labelled = language_id.label(rows, net, name["text"], ("_language", "_score"))
    accepted = (F.col("_language") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)
    return labelled.where(accepted).select(*name.values()).toDF(*name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of smallest id, and of equal ids the first stored.

    Rows without an id come after all others. Texts without words stay. Of repeated rows
    one stays; an empty table gives no rows; other columns pass through.
    """
    ship(spark)
    rows, name = private(docs)
    key, text = F.col(name["doc_id"]), F.col(name["text"])
    place = F.struct(key.isNull().alias("unnamed"), key.alias("doc_id"), "_row").alias("_place")
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_join(rows.select(place, text.alias("text")), SHINGLE_WORDS, SIMILAR, OF, key="_place")
    later = groups.where("_place._row != component_id._row").select("_place._row")
    return rows.join(later, "_row", "left_anti").select(*name.values()).toDF(*name)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes that an earlier place has too.

    A document of which nothing is left goes; ``n_chars`` counts what is left. Of repeated
    rows the first keeps its text; an empty table gives no rows; other columns pass through.
    """
    ship(spark)
    rows, name = private(docs)
    others = [c for own, c in name.items() if own not in ("text", "n_chars")]
    cut = repeats.remove_repeats(rows, key=name["doc_id"], text=name["text"], keep=others, whole_characters=True)
    left = cut.where("n_removed < n_bytes OR n_bytes = 0").withColumn(name["text"], F.col("kept").cast("string"))
    left = left.withColumn(name["n_chars"], F.char_length(name["text"]).cast("long"))
    return left.select(*name.values()).toDF(*name)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents in sequences of at most 2048.

    Repeated rows are packed each, an empty table gives no rows, other columns are not read.
    """
    ship(spark)
    rows, name = private(docs)
    return packing.pack(rows, f"{TOKENIZERS}/word_bpe_49k.json", key=name["doc_id"], text=name["text"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL cannot express the network, the join and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
