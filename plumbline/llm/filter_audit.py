"""How filters interact: what each removes after every prefix of every order, by relations of failing ids.

Each filter's failing rows are stored as a table of row numbers. Joins with those tables
alone say which rows outlive a set of filters, which of them the next filter removes,
which it would have removed but for an earlier one, and which labelled rows go.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.storing import releasing, store
from plumbline.sources.shared import fresh_path

PIECE_BYTES = 1 << 20
HOT_TEXTS = 1000
_SPACE = re.compile(rb"[ \t-\r]")
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = "n_words long, n_distinct long, n_capitals long, n_points long, marked boolean, digest binary"


def text_counts(text: bytes) -> tuple[int, int, int, int, bool, bytes]:
    """Words, distinct words, A-Z, code points, whether a mark occurs, and SHA-256.

    Words are read a piece at a time, cut at white space, so a very long text takes
    the room of its distinct words.
    """
    n, distinct, lo = 0, set(), 0
    while lo < len(text):
        space = _SPACE.search(text, lo + PIECE_BYTES)
        hi = space.start() if space else len(text)
        words = text[lo:hi].split()
        n += len(words)
        distinct.update(words)
        lo = hi
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return n, len(distinct), capitals, points, _MARKS.search(text) is not None, hashlib.sha256(text).digest()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    names = [f.split()[0] for f in COUNTS.split(", ")]
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        rows = [text_counts(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, *made], ["row", "key", "part", *names])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``row, key, part`` and the counts of each text; stored, so a row keeps its number.

    A null text is empty, a null part the empty string.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    return store(rows.mapInArrow(_count_batches, f"row long, key {kind}, part string, {COUNTS}"), "measured")


def copies(measured: DataFrame) -> DataFrame:
    """Rows whose text a row of smaller key has too; a null key is neither smaller nor larger than any.

    The least key of a text is pre-aggregated. The ``HOT_TEXTS`` most repeated texts, as many
    rows at most, are broadcast; any other has less than that part of the rows, and meets its least
    key by a shuffle.
    """
    least = measured.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = store(least, "copied")
    hot = F.broadcast(least.orderBy(F.desc("n"), "digest").limit(HOT_TEXTS).select("digest", F.struct("least").alias("hot")))
    met = measured.join(hot, "digest", "left")
    common = met.where(F.col("key") > F.col("hot.least")).drop("hot")
    others = met.where("hot IS NULL").drop("hot").alias("m")
    later = (F.col("m.digest") == F.col("l.digest")) & (F.col("m.key") > F.col("l.least"))
    return common.unionByName(others.join(least.alias("l"), later, "left_semi"))


def id_tables(failing: dict[str, DataFrame]) -> DataFrame:
    """One stored table of ``row, part`` for each name, as ``filter, row, part`` partitioned by ``filter``."""
    named = [df.select("row", "part", F.lit(name).alias("filter")) for name, df in failing.items()]
    whole = reduce(DataFrame.unionByName, named)
    path = fresh_path(whole.sparkSession, "failing")
    with releasing(whole.sparkSession):
        whole.write.partitionBy("filter").parquet(path)
    return whole.sparkSession.read.schema("row long, part string, filter string").parquet(path)


def _bit(name: str, filters: list[str]) -> int:
    return 1 << filters.index(name)


def relation_counts(ids: DataFrame, failing: DataFrame, filters: list[str], labelled: dict[str, DataFrame]) -> DataFrame:
    """``part, kind, filter, before, n`` for every set ``before`` of filters, a bit each.

    Kinds: ``all`` rows; ``clean`` rows, which fail nothing; ``survivors`` among the
    failing rows; ``removed`` by a filter after a set; the labelled among those; and
    ``redundant<g>``, the rows of a filter that ``g`` is the first of the set to take.
    Everything starts from failing rows and is joined on their numbers: one shuffle of
    each id table, after which sets are added filter by filter inside the tasks.
    """
    tables = {f: failing.where(F.col("filter") == f).select(F.col("row").alias("gone")) for f in filters}
    own = failing.where(F.col("filter").isin(filters))
    some = own.select("row", "part").distinct()
    populations = [own.withColumn("kind", F.lit("removed"))]
    for name, rows in labelled.items():
        populations.append(own.join(rows.select("row"), "row", "left_semi").select(*own.columns, F.lit(name).alias("kind")))
    populations.append(some.select("row", "part", F.lit("").alias("filter"), F.lit("survivors").alias("kind")))
    alive = reduce(DataFrame.unionByName, populations).withColumn("before", F.lit(0)).repartition("row")

    counted = []
    for g in filters:
        table, bit = tables[g], _bit(g, filters)
        others = alive.where((F.col("kind") == "removed") & (F.col("filter") != g))
        taken = others.join(table, F.col("row") == F.col("gone"), "left_semi")
        counted.append(taken.withColumn("kind", F.lit(f"redundant{g}")).select("part", "kind", "filter", "before"))
        both = F.array(F.col("before"), F.col("before").bitwiseOR(bit))
        sets = F.explode(F.when(F.col("filter") == g, F.array("before")).otherwise(both))
        alive = alive.withColumn("before", sets)
        hit = (F.col("row") == F.col("gone")) & (F.col("before").bitwiseAND(bit) != 0)
        alive = alive.join(table, hit, "left_anti")
    counted.append(alive.select("part", "kind", "filter", "before"))
    plain = [F.lit("").alias("filter"), F.lit(0).alias("before")]
    counted.append(ids.select("part", F.lit("all").alias("kind"), *plain))
    clean = ids.join(some.select("row"), "row", "left_anti")
    counted.append(clean.select("part", F.lit("clean").alias("kind"), *plain))
    return reduce(DataFrame.unionByName, counted).groupBy("part", "kind", "filter", "before").agg(F.count("*").alias("n"))


def _steps(filters: list[str]) -> list[dict]:
    """Every order and step, with the set of filters before it."""
    out = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(order), "step": k + 1, "filter": f, "before": before})
            before |= _bit(f, filters)
    return out


def audit(ids: DataFrame, failing: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """Effect of every filter at every step of every order, by part.

    ``ids`` has ``row`` (unique) and ``part``; ``failing`` names each filter, by one
    letter, with its failing rows; ``labelled`` names each loss with the rows that bear
    the label. Columns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, <losses>, shapley``: rows left after the step, removed by it, failing
    its filter but removed before, failing its filter alone, labelled and removed by it,
    and the removals of its filter summed over all orders.

    One row a part, order and step, zeros included. A filter that nothing fails removes
    nothing. An empty table has no parts and gives no rows.
    """
    filters = list(failing)
    stored = id_tables(failing | {f"+{name}": df for name, df in labelled.items()})
    marks = {name: stored.where(F.col("filter") == f"+{name}") for name in labelled}
    counts = store(relation_counts(ids, stored, filters, marks), "counts")
    everything = (1 << len(filters)) - 1

    key = F.concat_ws("/", "kind", "filter", "before")
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("n"))
    steps = F.from_json(
        F.lit(json.dumps(_steps(filters))), "array<struct<filter_order:string,step:int,filter:string,before:int>>"
    )
    rows = by_part.select("part", "n", F.explode(steps).alias("s")).select("part", "n", "s.*")

    def look(kind: str, name: Column, before: Column) -> Column:
        entry = F.concat_ws("/", F.lit(kind), name, before.cast("string"))
        return F.coalesce(F.try_element_at("n", entry), F.lit(0)).cast("long")

    name, before, none = F.col("filter"), F.col("before"), F.lit("")
    bits = F.create_map(*[F.lit(x) for f in filters for x in (f, _bit(f, filters))])
    own = bits[name]

    def total(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms)

    redundant = total(
        [
            F.when(before.bitwiseAND(b) != 0, look(f"redundant{g}", name, before.bitwiseAND(b - 1))).otherwise(0)
            for g, b in ((g, _bit(g, filters)) for g in filters)
        ]
    )
    orders = [factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()) for s in range(everything)]
    shapley = total([look("removed", name, F.lit(s)) * F.lit(w) for s, w in enumerate(orders)])
    return rows.select(
        "part",
        "filter_order",
        "step",
        (look("clean", none, F.lit(0)) + look("survivors", none, before.bitwiseOR(own))).alias("kept"),
        look("removed", name, before).alias("removed"),
        redundant.alias("redundant"),
        look("removed", name, F.lit(everything) - own).alias("unique_fails"),
        *[look(loss, name, before).alias(loss) for loss in labelled],
        shapley.alias("shapley"),
    )


def audit_texts(
    docs: DataFrame,
    failing: dict[str, Callable[[DataFrame], DataFrame]],
    labels: dict[str, DataFrame],
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """``audit`` of text filters: each picks its failing rows from what ``measure`` gives.

    ``labels`` names each loss with a table whose first column holds the keys that bear the label; a
    key that stands there twice counts once, and a null key bears none. Documents that
    share a key are rows of their own. Other columns are not read.
    """
    measured = measure(docs, key, text, part)
    ids = measured.select("row", "part")
    relations = {}
    for name, table in labels.items():
        keys = table.select(F.col(table.columns[0]).alias("key")).distinct()
        relations[name] = measured.join(keys, "key", "left_semi").select("row", "part")
    return audit(ids, {f: pick(measured).select("row", "part") for f, pick in failing.items()}, relations)
