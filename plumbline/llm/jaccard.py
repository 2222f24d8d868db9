"""Exact Jaccard join of word-shingle sets, size-aware: subsets for small sets, lists for large ones.

All sets share one order of shingles, frequent ones last. Sets that link have most
elements in common, so the first few of each in that order (its prefix) must agree:

* a small set enumerates every pair of shingles of its prefix; two small sets that
  link share a pair, or one shingle where the threshold is low and both are tiny,
  which is why tiny sets enumerate their shingles singly too;
* a large set scans the inverted lists of its prefix; two sets that link meet in at
  least ``SHARED`` lists. Small sets within reach of a large one are listed too.

The size that parts small from large is the one of least estimated cost. Candidates
are verified on their whole sets; what is emitted are links that span each task's
components, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import bytetext
from plumbline.llm.components import connected_components
from plumbline.llm.storing import store

SUBSET = 2
SHARED = 4
LEAST_LARGE = 10
LARGEST_SIZE_CLASS = 100_000
FREQUENT = 8
MAX_FREQUENT = 1 << 18
SAMPLE = 256
SHORT_LIST = 32
BLOCK = 256
VERIFY_BYTES = 8_000_000
COLUMNS = 8192

PAIR_BY_LIST, PAIR_BY_SUBSET, LONG_LIST = 0, 1, 2


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least ``num / den``, in whole numbers."""

    num: int
    den: int

    def overlap(self, size: np.ndarray | int) -> np.ndarray | int:
        """Elements that a set shares with any set it links with, at least."""
        return -(-self.num * size // self.den)

    def single(self) -> int:
        """Largest size of a set that links with another over one common element."""
        return self.den // self.num

    def least_large(self) -> int:
        """Least size of a small set beyond which all linked sets share ``SHARED`` elements."""
        return max(LEAST_LARGE, (SHARED - 1) * self.den // self.num)

    def prefix(self, size: np.ndarray | int, shared: int) -> np.ndarray | int:
        """Length of prefix that has ``shared`` elements in common with a linked set's."""
        return size - self.overlap(size) + np.minimum(shared, self.overlap(size))


def set_keys(grams: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each set, whatever the order of its elements."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(bytetext.mix(grams, salt))])
    return bytetext.signed(bytetext.mix(sums[offsets[1:]] - sums[offsets[:-1]], salt))


def describe_sets(n: int) -> Callable:
    """Document to its set's size and 128-bit key; the first half names the set. The hash of its text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, grams, offsets in bytetext.shingle_sets(batch.column(1), n):
                rows = len(offsets) - 1
                own = [batch.column(c).slice(first, rows) for c in (0, 2)]
                columns = [*own, pa.array(np.diff(offsets)), pa.array(set_keys(grams, offsets, 1)), pa.array(set_keys(grams, offsets, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "words", "n", "uid", "check"])

    return run


def _distinct_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(uid, shingles, offsets)`` of a batch's sets, copies and empty sets left out."""
    seen = np.zeros(0, np.int64)
    for _, grams, offsets in bytetext.shingle_sets(column, n):
        uid, size = set_keys(grams, offsets, 1), np.diff(offsets)
        keep = np.zeros(len(uid), bool)
        keep[np.unique(uid, return_index=True)[1]] = True
        keep &= (size > 0) & ~np.isin(uid, seen)
        seen = np.concatenate([seen, uid[keep]])
        pick = np.repeat(keep, size)
        yield uid[keep], grams[pick], np.concatenate([[0], np.cumsum(size[keep])])


def local_counts(n: int) -> Callable:
    """Shingles that a batch holds more than once, and a hashed sample of all, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [grams for _, grams, _ in _distinct_sets(batch.column(0), n)]
            grams, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            sampled = grams % np.uint64(SAMPLE) == 0
            keep = (counts > 1) | sampled
            yield pa.RecordBatch.from_arrays([pa.array(bytetext.signed(grams[keep])), pa.array(counts[keep]), pa.array(sampled[keep])], ["h", "df", "sampled"])

    return run


def choose_boundary(sizes: np.ndarray, counts: np.ndarray, similar: Similarity, list_length: float) -> int:
    """Largest size of a small set: least rows enumerated plus rows scanned."""
    least = similar.least_large()
    if not len(sizes):
        return least
    pairs = similar.prefix(sizes, SUBSET)
    small = np.cumsum(counts * np.maximum(pairs * (pairs - 1) / 2, 1))
    scanned = counts * similar.prefix(sizes, SHARED) * (1.0 + list_length)
    from_size = np.concatenate([np.cumsum(scanned[::-1])[::-1], [0.0]])
    reach = np.searchsorted(sizes, similar.overlap(sizes + 1))
    cost = small + from_size[reach]
    allowed = sizes >= least
    return int(sizes[allowed][np.argmin(cost[allowed])]) if allowed.any() else least


def signatures(n: int, similar: Similarity, boundary: int, frequent: np.ndarray, weight: np.ndarray) -> Callable:
    """Sets to signatures ``kind, sig, uid, n``."""
    reach = similar.overlap(boundary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, grams, offsets in _distinct_sets(batch.column(0), n):
                size = np.diff(offsets)
                rank = np.zeros(len(grams), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                    rank = np.where(frequent[at] == grams, weight[at], 0)
                owner = np.repeat(np.arange(len(size)), size)
                grams = grams[np.argsort((owner << 40) + rank, kind="stable")]
                out = []
                small = np.flatnonzero(size <= boundary)
                width = similar.prefix(size, SUBSET)
                for p in np.unique(width[small]):
                    rows = small[width[small] == p]
                    prefix = grams[offsets[rows][:, None] + np.arange(p)]
                    if p == 1:
                        sig = bytetext.mix(prefix, 11)
                    else:
                        i, j = np.triu_indices(p, 1)
                        sig = bytetext.mix(bytetext.mix(prefix[:, i], 12) + prefix[:, j], 13)
                    out.append((PAIR_BY_SUBSET, sig.ravel(), np.repeat(rows, sig.shape[1])))
                tiny = np.flatnonzero((size <= similar.single()) & (width > 1))
                ones = bytetext.mix(grams[bytetext.ranges(offsets[tiny], size[tiny])], 11)
                out.append((PAIR_BY_SUBSET, ones, np.repeat(tiny, size[tiny])))
                large = np.flatnonzero(size >= reach)
                count = similar.prefix(size[large], SHARED)
                out.append((PAIR_BY_LIST, bytetext.mix(grams[bytetext.ranges(offsets[large], count)], 14), np.repeat(large, count)))
                for kind, sig, rows in out:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), kind, np.int32)), pa.array(bytetext.signed(sig)), pa.array(uid[rows]), pa.array(size[rows])],
                            ["kind", "sig", "uid", "n"],
                        )

    return run


def meet(similar: Similarity) -> Callable:
    """Signatures sorted by ``sig, uid`` to candidate pairs, or to the list itself where it is long.

    Holds one batch and a list's first ``SHORT_LIST`` rows.
    """

    def pairs(kind: np.ndarray, sig: np.ndarray, uid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Whole lists of at most ``SHORT_LIST`` rows, and parts of long ones."""
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(sig)))
        long = np.repeat(length > SHORT_LIST, length)
        kinds, xs, ys, ns = [np.full(int(long.sum()), LONG_LIST)], [sig[long]], [uid[long]], [n[long]]
        for m in np.unique(length[(length > 1) & (length <= SHORT_LIST)]):
            rows = start[length == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            i, j = rows[:, i].ravel(), rows[:, j].ravel()
            ok = similar.overlap(np.maximum(n[i], n[j])) <= np.minimum(n[i], n[j])
            i, j = i[ok], j[ok]
            kinds.append(kind[i])
            xs.append(uid[i])
            ys.append(uid[j])
            ns.append(n[i])
        arrays = [np.concatenate(v) for v in (kinds, xs, ys, ns)]
        return pa.RecordBatch.from_arrays([pa.array(arrays[0].astype(np.int32)), *(pa.array(v) for v in arrays[1:])], ["kind", "x", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        long_sig = None  # a list already known to be long, whose rows are passed on as they come
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in ("kind", "sig", "uid", "n")]
            if held is not None:
                rows = [np.concatenate(v) for v in zip(held, rows, strict=True)]
                held = None
            if not len(rows[0]):
                continue
            fresh = np.ones(len(rows[1]), bool)
            fresh[1:] = (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            rows = [v[fresh] for v in rows]
            if long_sig is not None:
                same = rows[1] == long_sig
                if same.any():
                    k, s, u, n = (v[same] for v in rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), LONG_LIST, np.int32)), pa.array(s), pa.array(u), pa.array(n)], ["kind", "x", "y", "n"])
                    rows = [v[~same] for v in rows]
                if not len(rows[0]):
                    continue
                long_sig = None
            last = int(np.flatnonzero(rows[1] == rows[1][-1])[0])
            if len(rows[1]) - last > SHORT_LIST:
                yield pairs(*rows)
                long_sig = rows[1][-1]
            else:
                held = [v[last:] for v in rows]
                if last:
                    yield pairs(*[v[:last] for v in rows])
        if held is not None and len(held[0]):
            yield pairs(*held)

    return run


def own_texts(n: int) -> Callable:
    """Rows whose text has the set that it is named by; drops texts that only share its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            keep = np.zeros(len(uid), bool)
            for first, grams, offsets in bytetext.shingle_sets(batch.column(1), n):
                rows = slice(first, first + len(offsets) - 1)
                keep[rows] = set_keys(grams, offsets, 1) == uid[rows]
            yield batch.filter(pa.array(keep))

    return run


def _overlaps(parts: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a cell's sets, a slice of the shingles at a time."""
    k = len(parts)
    owner = np.repeat(np.arange(k), [len(p) for p in parts])
    grams = np.concatenate(parts)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    total = np.zeros((k, k), np.float32)
    for lo in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((k, COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        total += held @ held.T
    return total.astype(np.int64)


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a matrix of links joins: each node to where it was reached from."""
    out, left = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            at = front.pop()
            reached = np.flatnonzero(links[at] & left)
            left[reached] = False
            out += [(at, int(r)) for r in reached]
            front += [int(r) for r in reached]
    return out


def verify(n: int, similar: Similarity) -> Callable:
    """Cells ``c1, c2, c3, uid, text`` sorted by cell to links that span each cell's components."""

    def solve(cells: np.ndarray, uid: np.ndarray, text: pa.Array) -> pa.RecordBatch:
        names, first, which = np.unique(uid, return_index=True, return_inverse=True)
        sets: list[np.ndarray] = []
        for _, grams, offsets in bytetext.shingle_sets(text.take(pa.array(first)), n):
            sets += np.split(grams, offsets[1:-1])
        edges = []
        bounds = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = which[a:b]
            parts = [sets[r] for r in rows]
            size = np.array([len(p) for p in parts])
            if len(rows) == 2:
                both = len(np.intersect1d(*parts, assume_unique=True))
                if similar.den * both >= similar.num * (size.sum() - both):
                    edges.append((names[rows[0]], names[rows[1]]))
            elif len(rows) > 2:
                both = _overlaps(parts)
                links = similar.den * both >= similar.num * (size[:, None] + size[None, :] - both)
                edges += [(names[rows[i]], names[rows[j]]) for i, j in _spanning(links)]
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def ids(table: pa.Table) -> np.ndarray:
            """One number a cell; its rows are next to each other."""
            columns = [table.column(c).to_numpy() for c in ("c1", "c2", "c3")]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            return np.cumsum(new)

        def drain(table: pa.Table, cells: np.ndarray) -> pa.RecordBatch:
            return solve(cells, table.column("uid").to_numpy(), table.column("text").combine_chunks())

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                size += part.nbytes
                if size < VERIFY_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                cells = ids(table)
                cut = int(np.searchsorted(cells, cells[-1]))
                if cut:
                    yield drain(table.slice(0, cut), cells[:cut])
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            yield drain(table, ids(table))

    return run


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The most frequent shingles with their counts, and how long the list of another is on average.

    At most ``MAX_FREQUENT`` are told to the workers (4 MB). They only order the
    shingles; any order gives the same links.
    """
    counts = store(texts.mapInArrow(local_counts(n), "h long, df long, sampled boolean").groupBy("h").agg(F.sum("df").alias("df"), F.max("sampled").alias("sampled")), "shingles")
    often = counts.where(F.col("df") >= FREQUENT)
    classes = often.groupBy(F.floor(F.log2("df")).alias("class")).count().orderBy(F.desc("class")).collect()
    least, total = 1 << 62, 0
    for row in classes:
        total += row["count"]
        if total > MAX_FREQUENT:
            break
        least = 1 << row["class"]
    top = often.where(F.col("df") >= least).select("h", "df").toArrow().sort_by("h")
    h, df = top.column("h").to_numpy(), top.column("df").to_numpy()
    order = np.argsort(h.view(np.uint64))
    rest = counts.where(F.col("sampled") & (F.col("df") < least)).agg(F.sum(F.col("df") * F.col("df")), F.sum("df")).first()
    return h.view(np.uint64)[order], df[order], (rest[0] / rest[1] if rest[1] else 1.0)


def jaccard_join(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Size of every document's set of ``n``-word shingles and its component of links.

    Words are split at ASCII white space and A-Z is lower-cased; a text with fewer
    words is one shingle. Two documents link when their sets' intersection is at least
    ``num / den`` of their union. Columns: the key, ``n_shingles``, ``component_id``
    (the smallest key reachable by links).

    A text that is null or without words has an empty set, links with nothing and is
    its own component. Equal sets link; they are one node with one set to verify.
    A null key takes part and never names a component unless all its keys are null.
    Repeated rows have a row each. An empty table gives no rows. Only the two columns
    are read. Sets are named by 64 bits of their hash and grouped by 128. The text of a
    set is found again by key and hash, so documents that share a key, or have none,
    do not meet each other.
    """
    similar = Similarity(num, den)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("words", F.xxhash64("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    sets = store(rows.mapInArrow(describe_sets(n), f"doc {kind}, words long, n long, uid long, check long"), "sets")
    classes = sets.where("n > 0").groupBy("uid", "check", "n").agg(F.min("doc").alias("least"))
    sizes = classes.groupBy(F.least("n", F.lit(LARGEST_SIZE_CLASS)).alias("n")).count().toArrow().sort_by("n")
    texts = rows.select("text")
    frequent, weight, list_length = _frequent(texts, n)
    boundary = choose_boundary(sizes.column("n").to_numpy(), sizes.column("count").to_numpy(), similar, list_length)

    signed = texts.mapInArrow(signatures(n, similar, boundary, frequent, weight), "kind int, sig long, uid long, n long")
    sorted_by = signed.repartition("sig").sortWithinPartitions("sig", "uid")
    met = store(sorted_by.mapInArrow(meet(similar), "kind int, x long, y long, n long"), "candidates")
    pairs = (
        met.where(F.col("kind") < LONG_LIST)
        .groupBy("x", "y")
        .agg(F.sum(F.when(F.col("kind") == PAIR_BY_SUBSET, SHARED).otherwise(1)).alias("shared"))
        .where(F.col("shared") >= SHARED)
    )
    none = F.lit(-1)
    pair_cells = pairs.select(F.col("x").alias("c1"), F.explode(F.array("x", "y")).alias("uid")).distinct()
    pair_cells = pair_cells.select("c1", none.alias("c2"), none.alias("c3"), "uid")
    long = _distinct_lists(met.where(F.col("kind") == LONG_LIST).select(F.col("x").alias("sig"), F.col("y").alias("uid")))
    cells = store(pair_cells.unionByName(_star_cells(long)), "cells")

    named = sets.where("n > 0").groupBy("uid").agg(F.min(F.struct("doc", "words")).alias("first"))
    wanted = cells.select("uid").distinct().join(named, "uid").select("uid", F.col("first.doc").alias("_doc"), F.col("first.words").alias("_words"))
    same = (F.col("words") == F.col("_words")) & F.col("doc").eqNullSafe(F.col("_doc"))
    chosen = rows.join(wanted, same).groupBy("uid").agg(F.first("text").alias("text"))
    with_text = store(chosen.mapInArrow(own_texts(n), "uid long, text string"), "texts")

    def verified(cells: DataFrame) -> DataFrame:
        shipped = cells.join(with_text, "uid").repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3")
        return store(shipped.mapInArrow(verify(n, similar), "x long, y long"), "links")

    links = verified(cells)
    if not long.isEmpty():
        links = links.unionByName(verified(_rest_cells(long, connected_components(links, "x", "y"))))
    return _components(sets, classes, links, key)


def _distinct_lists(long: DataFrame) -> DataFrame:
    """One of the long lists with the same members."""
    low = F.xxhash64("uid").bitwiseAND(F.lit((1 << 40) - 1))
    lists = long.groupBy("sig").agg(F.count("*").alias("m"), F.sum(low).alias("members"))
    return store(long.join(lists.groupBy("m", "members").agg(F.min("sig").alias("sig")).select("sig"), "sig"), "lists")


def _star_cells(long: DataFrame) -> DataFrame:
    """Each member of a long list with the list's leader, the member of most long lists.

    A leader's members over all its lists are dealt into cells of about ``BLOCK``.
    """
    degree = long.groupBy("uid").agg(F.count("*").alias("degree"))
    leaders = long.join(degree, "uid").groupBy("sig").agg(F.max(F.struct("degree", "uid"))["uid"].alias("c1"))
    star = long.join(leaders, "sig").select("c1", "uid").distinct()
    slices = star.groupBy("c1").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int")
    cells = star.join(slices, "c1").select("c1", own.alias("c2"), F.lit(-2).alias("c3"), "uid")
    return cells.unionByName(cells.select("c1", "c2", "c3", F.col("c1").alias("uid"))).distinct()


def _rest_cells(long: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of a long list's members that are not in one component yet, as blocks against blocks.

    The members outside the list's largest component meet all members, so every pair
    across components is in a cell. Lists within one component have none.
    """
    tagged = long.join(nodes.withColumnRenamed("node", "uid"), "uid", "left").select("sig", "uid", F.coalesce("component", "uid").alias("comp"))
    parts = tagged.groupBy("sig", "comp").count()
    top = F.max(F.struct("count", "comp"))
    lists = (
        parts.groupBy("sig").agg(top.alias("top"), F.sum("count").alias("m"), F.count("*").alias("parts")).where("parts > 1")
        .select(
            "sig",
            F.col("top.comp").alias("top"),
            F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("m") - F.col("top.count")) / BLOCK).cast("int").alias("rest_blocks"),
        )
    )
    rows = tagged.join(lists, "sig")
    every = rows.withColumn("own", F.pmod(F.xxhash64("uid", "sig"), F.col("blocks")).cast("int"))
    rest = rows.where("comp != top").withColumn("own", F.pmod(F.xxhash64("sig", "uid"), F.col("rest_blocks")).cast("int"))
    count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = every.select(F.col("sig").alias("c1"), count("rest_blocks").alias("c2"), F.col("own").alias("c3"), "uid")
    two = rest.select(F.col("sig").alias("c1"), F.col("own").alias("c2"), count("blocks").alias("c3"), "uid")
    return one.unionByName(two).distinct()


def _components(sets: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Every document's component from the links of sets. Equal sets are joined as one class."""
    nodes = connected_components(links, "x", "y")
    rooted = classes.join(nodes, F.col("uid") == F.col("node"), "left").drop("node")
    linked = rooted.where("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("uid", "check", "n", "component_id")
    alone = rooted.where("component IS NULL").select("uid", "check", "n", F.col("least").alias("component_id"))
    classed = store(named.unionByName(alone), "classes")
    return (
        sets.join(classed, ["uid", "check", "n"], "left")
        .select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    )
