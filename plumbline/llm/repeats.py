"""Exact removal of long repeated byte strings, by sampled anchors and bucket-pointer refinement.

Every string of ``length`` bytes has one anchor: its q-gram of least hash, the
leftmost of equals. Equal strings have equal anchors at the same place, so strings
are compared only with those of the same anchor. Consecutive strings with one
anchor form a run: an anchor, its context (the bytes the run covers) and where it
lies. Runs are sparse, about one in thirty-five bytes.

1. Runs of a batch with one anchor and context are folded to the earliest; the rest
   are repeats. The survivors meet by anchor, sorted, and the same is done again.
2. Anchors that have several contexts are refined: their contexts are fetched, and
   a suffix array to the depth of ``length`` tells which strings are equal.
3. The repeats of each document are cut out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import bytetext
from plumbline.llm.storing import store

LENGTH = 100
QGRAM = 32
FIRST = 8
HOT_CONTEXTS = 20_000
BATCH_ROWS = 20_000
NO_KEY = -(2**63)

RUN = "kind int, a long, c long, doc long, row long, lo long, n int"
_RUN_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_RUN_NAMES = ["kind", "a", "c", "doc", "row", "lo", "n"]
KEPT, REMOVED = 0, 1


def _run_batch(kind: np.ndarray, a, c, doc, row, lo, n) -> pa.RecordBatch:
    columns = [kind.astype(np.int32), a, c, doc, row, lo, n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _RUN_TYPES, strict=True)], _RUN_NAMES)


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each window of ``width``."""
    at = np.arange(len(values), dtype=np.int64 if len(values) > 2**31 else np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.minimum(values[step:], values[:-step])
        span += step
    return at


def runs_of(flat: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """``(row, anchor hash, context hash, first start in the row, count)`` of the runs of all rows."""
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none, none, none, none
    sums, down = bytetext.prefix_hash(flat)
    m = len(flat) - q + 1
    grams = bytetext.mix((sums[q:] - sums[:m]) * down[:m])
    at = _leftmost_minimum((grams >> np.uint64(32)).astype(np.uint32), length - q + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + length <= offsets[1:][row]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none
    anchor, owner = at[starts], row[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    begin, anchor, owner = starts[first], anchor[first].astype(np.int64), owner[first]
    context = bytetext.span_hash(sums, down, begin, begin + count + length - 1)
    context = bytetext.mix(context + (anchor - begin).astype(np.uint64), 7)
    return owner, bytetext.signed(grams[anchor]), bytetext.signed(context), begin - offsets[owner], count


def _fold(a: np.ndarray, c: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Of runs with one anchor and context, the earliest is kept and the others are repeats."""
    order = np.lexsort((lo, row, doc, c, a))
    a, c, doc, row, lo, n = a[order], c[order], doc[order], row[order], lo[order], n[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    same = (row == row[head]) & (lo == lo[head])
    keep = fresh | ~same
    kind = np.where(fresh, KEPT, REMOVED)
    return _run_batch(kind[keep], a[keep], c[keep], doc[keep], row[keep], lo[keep], n[keep])


def find_runs(length: int, q: int, segment: int = bytetext.CHUNK_BYTES) -> Callable:
    """``doc, text, row`` to folded runs. A text longer than ``segment`` is read in overlapping parts.

    Without ``row`` every row has a ``doc`` of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else docs
            for first, _, flat, offsets in bytetext.chunks(batch.column(1)):
                parts = []
                if len(offsets) == 2 and len(flat) > segment:
                    for at in range(0, len(flat), segment):
                        piece = flat[at : at + segment + length - 1]
                        owner, a, c, lo, n = runs_of(piece, np.array([0, len(piece)]), length, q)
                        parts.append((owner, a, c, lo + at, n))
                else:
                    parts.append(runs_of(flat, offsets, length, q))
                owner, a, c, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                if len(owner):
                    yield _fold(a, c, docs[first + owner], rows[first + owner], lo, n)

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, context and place to repeats, and to the runs left to refine.

    Holds one batch and one run: the first of an anchor is kept back until a second
    context of it comes.
    """
    back = None  # the last run seen that began an anchor and has not been passed on
    seen = None  # the head of the current anchor and context
    for batch in batches:
        known = pa.compute.equal(batch.column("kind"), REMOVED)
        if pa.compute.any(known).as_py():
            yield batch.filter(known)
            batch = batch.filter(pa.compute.invert(known))
        a, c, doc, row, lo, n = (batch.column(k).to_numpy() for k in _RUN_NAMES[1:])
        if not len(a):
            continue
        new_a, new_c = np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
        if seen is not None:
            new_a[0] = a[0] != seen[0]
            new_c[0] = new_a[0] or c[0] != seen[1]
        heads = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), -1))
        head_row = np.where(heads >= 0, row[heads], seen[2] if seen is not None else 0)
        head_lo = np.where(heads >= 0, lo[heads], seen[3] if seen is not None else 0)
        repeat = ~new_c & ((row != head_row) | (lo != head_lo))
        group = np.cumsum(new_a)
        contexts = np.bincount(group, weights=new_c, minlength=group[-1] + 1)
        refine = new_c & (contexts[group] + (group == 0) > 1)
        if back is not None and contexts[0] > 0:
            yield _run_batch(np.array([KEPT]), *[np.array([x]) for x in back])
            back = None
        keep = repeat | refine
        if keep.any():
            kind = np.where(repeat, REMOVED, KEPT)
            yield _run_batch(kind[keep], a[keep], c[keep], doc[keep], row[keep], lo[keep], n[keep])
        if group[-1] > 0:
            i = int(np.flatnonzero(new_a)[-1])
            back = (a[i], c[i], doc[i], row[i], lo[i], n[i]) if contexts[group[-1]] == 1 else None
        h = int(heads[-1])
        seen = (a[-1], c[-1], head_row[-1], head_lo[-1]) if h < 0 else (a[h], c[h], row[h], lo[h])


def refine_buckets(flat: np.ndarray, left: np.ndarray, length: int, first: int = FIRST) -> np.ndarray:
    """Bucket pointer of every position with ``length`` bytes left: equal if and only if the strings are.

    ``left`` counts the bytes from a position to the end of its context. Buckets of the
    first ``first`` bytes are refined by the pointers found at later offsets; pointers
    updated in one pass serve the next, so each doubles the depth. A pointer is the
    place where its bucket starts in sorted order. Buckets of one are left alone, and
    so are positions whose context ends before the depth. Positions with fewer bytes
    than ``length`` get -1.
    """
    pointer = np.full(len(flat), -1, np.int64)

    def split(at: np.ndarray, base: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((key, base))
        at, base, key, slot = at[order], base[order], key[order], np.arange(len(at))
        bucket, new = np.ones(len(at), bool), np.ones(len(at), bool)
        bucket[1:] = base[1:] != base[:-1]
        new[1:] = bucket[1:] | (key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(bucket, slot, 0))
        pointer[at] = base + np.maximum.accumulate(np.where(new, slot, 0)) - head

    at = np.flatnonzero(left >= first)
    key = np.zeros(len(at), np.uint64)
    for k in range(first):
        key = (key << np.uint64(8)) | flat[at + k]
    split(at, np.zeros(len(at), np.int64), key)
    depth = first
    while depth < length and len(at):
        step = min(depth, length - depth)
        at = at[left[at] >= depth + step]
        again = at[np.bincount(pointer[at], minlength=1)[pointer[at]] > 1] if len(at) else at
        if len(again):
            split(again, pointer[again], pointer[again + step])
        depth += step
    pointer[left < length] = -1
    return pointer


def _spans(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Starts of repeated strings as runs of consecutive ones."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    return pa.RecordBatch.from_arrays(
        [pa.array(row[first]), pa.array(start[first]), pa.array(np.diff(np.append(first, len(row))).astype(np.int32))],
        ["row", "lo", "n"],
    )


def refine(length: int, rows: int = BATCH_ROWS) -> Callable:
    """Contexts sorted by anchor to the repeated strings among them, some anchors at a time."""

    def solve(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(flat))
        pointer = refine_buckets(flat, left, length)
        at = np.flatnonzero(pointer >= 0)
        owner = np.searchsorted(offsets, at, "right") - 1
        start = lo[owner] + at - offsets[owner]
        order = np.lexsort((start, row[owner], doc[owner], pointer[at]))
        at, owner, start = at[order], owner[order], start[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = pointer[at][1:] != pointer[at][:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        later = (row[owner] != row[owner][head]) | (start != start[head])
        return _spans(row[owner][later], start[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def drain(table: pa.Table) -> pa.RecordBatch:
            flat, offsets = bytetext.buffers(table.column("context"))
            doc, row, lo = (table.column(c).to_numpy() for c in ("doc", "row", "lo"))
            return solve(doc, row, lo, flat, offsets)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                table = pa.Table.from_batches(held)
                a = table.column("a").to_numpy()
                other = np.flatnonzero(a != a[-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield drain(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    count = table.num_rows - cut
        if count:
            yield drain(pa.Table.from_batches(held))

    return run


def fetch(length: int) -> Callable:
    """Documents with the places of their runs to the runs' contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, flat, offsets in bytetext.chunks(batch.column(1)):
                places = batch.column(2).slice(first, end - first)
                owner = np.repeat(np.arange(end - first), np.diff(places.offsets.to_numpy()))
                runs = places.flatten()
                a, lo, n, hot = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                docs = batch.column(0).slice(first, end - first).to_numpy()[owner]
                rows = batch.column(3).slice(first, end - first).to_numpy()[owner]
                begin = offsets[owner] + lo
                size = np.maximum(np.minimum(n + length - 1, offsets[1:][owner] - begin), 0)
                for want in (False, True):
                    pick = np.flatnonzero(hot == want)
                    if not len(pick):
                        continue
                    if want:  # each string on its own, keyed by its hash
                        sums, down = bytetext.prefix_hash(flat)
                        count = np.maximum(size[pick] - length + 1, 0)
                        at = bytetext.ranges(begin[pick], count)
                        key = bytetext.signed(bytetext.span_hash(sums, down, at, at + length))
                        of, row, start = np.repeat(docs[pick], count), np.repeat(rows[pick], count), at - np.repeat(offsets[owner[pick]], count)
                        context = pa.nulls(len(at), pa.binary())
                    else:
                        key, of, row, start = a[pick], docs[pick], rows[pick], lo[pick]
                        data, bound = flat[bytetext.ranges(begin[pick], size[pick])], np.concatenate([[0], np.cumsum(size[pick])])
                        context = pa.Array.from_buffers(pa.large_binary(), len(pick), [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(row), pa.array(start), context], ["a", "doc", "row", "lo", "context"])

    return run


def cut_out(length: int, whole_characters: bool) -> Callable:
    """Documents with their repeated strings to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, flat, offsets in bytetext.chunks(batch.column(1)):
                places = batch.column(2).slice(first, end - first)
                owner = np.repeat(np.arange(end - first), np.diff(places.offsets.to_numpy()))
                runs = places.flatten()
                lo, n = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                begin = np.minimum(offsets[owner] + lo, offsets[1:][owner])
                stop = np.minimum(begin + n + length - 1, offsets[1:][owner])
                depth = np.bincount(begin, minlength=len(flat) + 1) - np.bincount(stop, minlength=len(flat) + 1)
                gone = np.cumsum(depth)[:-1] > 0
                if whole_characters and len(flat):
                    starts = np.flatnonzero((flat & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(flat))))
                before = np.concatenate([[0], np.cumsum(gone)])
                opens, closes = gone.copy(), gone.copy()
                opens[1:] &= ~gone[:-1]
                closes[:-1] &= ~gone[1:]
                edges = offsets[(offsets > 0) & (offsets < len(flat))]
                opens[edges], closes[edges - 1] = gone[edges], gone[edges - 1]
                opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                spans = np.searchsorted(opens, offsets)
                shift = np.repeat(offsets[:-1], np.diff(spans))
                bound = offsets - before[offsets]
                kept = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(bound), pa.py_buffer(flat[~gone].tobytes())])
                span = pa.StructArray.from_arrays([pa.array(opens - shift), pa.array(closes - shift)], ["start", "end"])
                columns = [
                    *(batch.column(i).slice(first, end - first) for i in range(3, batch.num_columns)),
                    kept.cast(pa.binary()),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(before[offsets])),
                    pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), span),
                ]
                names = batch.schema.names[3:] + ["kept", "n_bytes", "n_removed", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """``row, lo, n``: in ``row``, the ``length``-byte strings that start at ``lo`` to ``lo + n - 1`` start earlier too.

    ``docs`` has ``doc`` (long, not null), ``text`` (string or binary) and ``row`` (long,
    unique): earlier is by ``doc``, then ``row``, then place. An anchor with
    more than ``HOT_CONTEXTS`` contexts is not refined as one group: its strings are
    compared one by one by their hashes, which spreads them and folds equal ones
    before the shuffle.
    """
    by_place = ["a", "c", "doc", "row", "lo"]
    meeting = F.when(F.col("kind") == KEPT, F.col("a")).otherwise(F.xxhash64("row", "lo"))
    runs = docs.select("doc", "text", "row").mapInArrow(find_runs(length, q), RUN).repartition(meeting).sortWithinPartitions(*by_place)
    met = store(runs.mapInArrow(meet, RUN), "runs")
    open_runs = met.where(F.col("kind") == KEPT)
    hot = open_runs.groupBy("a").count().where(F.col("count") > HOT_CONTEXTS).select("a", F.lit(True).alias("hot"))
    place = F.struct("a", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = open_runs.join(hot, "a", "left").groupBy("row").agg(F.collect_list(place).alias("places"))
    found = docs.join(wanted, "row").select("doc", "text", "places", "row")
    contexts = store(found.mapInArrow(fetch(length), "a long, doc long, row long, lo long, context binary"), "contexts")
    cold = contexts.where("context IS NOT NULL").repartition("a").sortWithinPartitions("a")
    single = contexts.where("context IS NULL").select("a", "doc", "row", "lo")
    heads = single.groupBy("a").agg(F.min(F.struct("doc", "row", "lo")).alias("head"))
    later = single.join(heads, "a").where(F.struct("doc", "row", "lo") != F.col("head"))
    spans = "row long, lo long, n int"
    return (
        met.where(F.col("kind") == REMOVED)
        .select("row", "lo", "n")
        .unionByName(cold.mapInArrow(refine(length), spans))
        .unionByName(later.select("row", "lo", F.lit(1).alias("n")))
    )


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """Every document without the bytes of ``length``-byte strings that also start earlier.

    Earlier is in a document of smaller key, in an earlier row of the same key, or
    before in the same row. Strings are judged on the input and may overlap. Columns: ``keep`` (the key by default),
    ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans``, the maximal removed
    runs. With ``whole_characters`` a UTF-8 character stays unless all its bytes are
    repeats, so that what is left is text. A null text counts as empty, a text shorter than ``length`` is left whole,
    a null key comes before all others. Rows that share a key, or have none, are
    documents of their own, in the order in which they are stored: of copies all but
    one go. An empty table gives no rows. Only the columns named are read, under
    names of this module; they are stored with a number for each row.
    """
    keep = keep or [key]
    held = [F.col(c).alias(f"_held{i}") for i, c in enumerate(keep)]
    content: Column = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), content.alias("text"), *held)
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    strings = repeated_strings(rows.select("doc", "text", "row"), length)
    places = strings.groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("places"))
    joined = rows.join(places, "row", "left").select(
        "doc", "text", F.coalesce("places", F.array().cast("array<struct<lo:bigint,n:int>>")).alias("places"), *[f"_held{i}" for i in range(len(keep))]
    )
    kinds = ", ".join(f"_held{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    spans = "array<struct<start:bigint,end:bigint>>"
    out = joined.mapInArrow(cut_out(length, whole_characters), f"{kinds}, kept binary, n_bytes long, n_removed long, spans {spans}")
    return out.withColumnsRenamed({f"_held{i}": c for i, c in enumerate(keep)})
