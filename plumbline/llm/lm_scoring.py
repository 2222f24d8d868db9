"""Bigram scores from a log-frequency Bloom filter that every worker holds.

The filter holds quantised counts: an n-gram with a count of ``2**(q-1)`` or more is
entered ``q`` times, as ``(n-gram, 1)`` to ``(n-gram, q)``. A count is read by asking
for 1, 2, ... until an answer is no. The filter never understates a quantised count
and overstates it as often as its bits are full, which is returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import bytetext
from plumbline.llm.storing import store

FILTER_BITS = 1 << 29
PROBES = 3
SEGMENT_NGRAMS = 1 << 21
MIN_SEGMENTS, MAX_SEGMENTS = 64, 1 << 13
MAX_HEAD = 1 << 20
PRIOR = 200.0
KEY_BYTES = 5
SHIPPED_KEYS = 1_000_000
END = np.uint64(0x5851F42D4C957F2D)
WORD, PAIR = 21, 22

U64 = np.uint64


def with_ends(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, each row closed by the end token, and row offsets."""
    hashes, rows = bytetext.word_hashes(flat, offsets)
    counts = np.diff(rows) + 1
    out = np.full(int(counts.sum()), END, U64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts - 1)] = hashes
    return out, np.concatenate([[0], np.cumsum(counts)])


def histories(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The token before each; the end token before the first of a row."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[rows[:-1]] = END
    return before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return bytetext.mix(bytetext.mix(before, PAIR) + tokens, PAIR)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a batch with their counts."""
    for batch in batches:
        parts = [np.unique(with_ends(flat, offsets)[0], return_counts=True) for _, _, flat, offsets in bytetext.chunks(batch.column(0))]
        if parts:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bytetext.signed(h)), pa.array(counts)], ["h", "c"])


@dataclass(frozen=True)
class Filter:
    """Bits dealt over segments by the first bits of a key; all probes of a key fall in one segment."""

    bits: int
    segments: int
    probes: int

    @property
    def segment_bits(self) -> int:
        return self.bits // self.segments

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - int(math.log2(self.segments)))).astype(np.int64) if self.segments > 1 else np.zeros(len(keys), np.int64)

    def places(self, keys: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
        """Bit in the segment. Reads only the bits of a key that are shipped."""
        short = keys & U64((1 << 8 * KEY_BYTES) - 1)
        h = bytetext.mix(short + np.asarray(level, U64) * U64(0xA24BAED4963EE407), 30 + probe)
        return (h % U64(self.segment_bits)).astype(np.int64)

    def fill(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One segment's bits with these n-grams entered, packed."""
        held = np.zeros(self.segment_bits, bool)
        level = np.frexp(counts.astype(np.float64))[1]
        for q in range(1, int(level.max(initial=0)) + 1):
            some = keys[level >= q]
            for probe in range(self.probes):
                held[self.places(some, q, probe)] = True
        return np.packbits(held)

    def read(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 where the first probe says no."""
        value = np.zeros(len(keys), np.int64)
        base = self.segment(keys) * self.segment_bits
        left, q = np.arange(len(keys)), 1
        while len(left):
            yes = np.ones(len(left), bool)
            for probe in range(self.probes):
                at = base[left[yes]] + self.places(keys[left[yes]], q, probe)
                yes[yes] = (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            left = left[yes]
            value[left] = 1 << (q - 1)
            q += 1
            if q > 62:
                break
        return value


def ship_ngrams(filt: Filter, head: Broadcast) -> Callable:
    """Pairs, and words outside the head, by segment: keys of five bytes and counts.

    Counts are summed over some chunks of text, as many as hold ``SHIPPED_KEYS`` keys.
    """

    def by_segment(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        cut = np.searchsorted(filt.segment(keys), np.arange(filt.segments + 1))
        ones = counts == 1
        columns: list[list] = [[], [], [], []]
        for s in range(filt.segments):
            own = slice(cut[s], cut[s + 1])
            single = ones[own]
            columns[0].append(s)
            columns[1].append(short[own][single].tobytes())
            columns[2].append(short[own][~single].tobytes())
            columns[3].append(counts[own][~single].astype("<u4").tobytes())
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["segment", "ones", "many", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, flat, offsets in bytetext.chunks(batch.column(0)):
                tokens, rows = with_ends(flat, offsets)
                words, counts = np.unique(tokens, return_counts=True)
                tail = head.value.find(words) < 0
                parts.append((bytetext.mix(words[tail], WORD), counts[tail]))
                parts.append(np.unique(pair_keys(histories(tokens, rows), tokens), return_counts=True))
                if sum(len(p[0]) for p in parts) >= SHIPPED_KEYS:
                    yield by_segment(parts)
                    parts = []
        if parts:
            yield by_segment(parts)

    return run


def fill_segment(filt: Filter) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        def keys(name: str) -> np.ndarray:
            flat = np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(flat), 8), np.uint8)
            wide[:, :KEY_BYTES] = flat
            return wide.view("<u8").ravel()

        ones, many = keys("ones"), keys("many")
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        distinct, at = np.unique(np.concatenate([ones, many]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(ones)), counts])).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        bits = filt.fill(distinct.astype(U64), total)
        return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "bits": pa.array([bits.tobytes()]), "ngrams": pa.array([len(distinct)])})

    return run


class Head:
    """Exact counts of the most frequent tokens."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each token, -1 where it is not held."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _scored(kind: int, row, size, known, base, score, own: list) -> pa.RecordBatch:
    columns = [np.full(len(row), kind, np.int32), row, np.asarray(size, np.int64), known, base, score]
    names = ["kind", "row", "n", "h", "base", "score", "key", "train"]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *own], names)


def score_texts(filt: Filter, bits: Broadcast, head: Broadcast, n: int, v: int, prior: float) -> Callable:
    """Texts to scores, and to their tokens outside the head with counts.

    Rows of kind 0 are texts: tokens, known tokens of the head, their part of the base
    score, the model's score. Rows of kind 1 are a text's tokens outside the head.
    """
    whole = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, end, flat, offsets in bytetext.chunks(batch.column(1)):
                tokens, rows = with_ends(flat, offsets)
                words, unit = np.unique(tokens, return_inverse=True)
                at = head.value.find(words)
                exact = np.where(at >= 0, head.value.c[at] if len(head.value.c) else 0, 0)
                count = exact.copy()
                tail = at < 0
                count[tail] = filt.read(bits.value, bytetext.mix(words[tail], WORD))
                before = histories(tokens, rows)
                end_at = np.searchsorted(words, END)
                last = np.empty_like(unit)
                last[1:] = unit[:-1]
                last[rows[:-1]] = end_at
                c_word, c_last = count[unit], count[last]
                seen = np.flatnonzero((c_word > 0) & (c_last > 0))
                keys, which = np.unique(pair_keys(before[seen], tokens[seen]), return_inverse=True)
                pair = np.zeros(len(tokens))
                pair[seen] = np.minimum(filt.read(bits.value, keys)[which], np.minimum(c_word[seen], c_last[seen]))
                below = (c_word + 1) / (n + v + 1)
                logs = np.log10((pair + prior * below) / (c_last + prior))
                base = np.where(tail, 0.0, np.log10(exact + 1.0))[unit]
                size = np.diff(rows)
                total = lambda x: np.add.reduceat(x, rows[:-1]) if len(size) else x[:0]
                doc = np.repeat(np.arange(end - first), size)
                known = total((~tail & (exact > 0))[unit].astype(np.int64))
                own = [batch.column(c).slice(first, end - first) for c in (2, 3)]
                yield _scored(0, ids[first:end], size, known, total(base) - size * whole, total(logs), own)
                rare = np.flatnonzero(tail[unit])
                if len(rare):
                    order = rare[np.lexsort((unit[rare], doc[rare]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (unit[order][1:] != unit[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    start = np.flatnonzero(new)
                    times = np.diff(np.append(start, len(order)))
                    zero = np.zeros(len(start))
                    own = [pa.nulls(len(start), batch.column(c).type) for c in (2, 3)]
                    yield _scored(1, ids[first + doc[order[start]]], times, bytetext.signed(tokens[order[start]]), zero, zero, own)

    return run


def fit_head(words: DataFrame, limit: int) -> Head:
    """The tokens of the highest counts, at most ``limit`` (12 MB); all others are joined."""
    classes = words.groupBy(F.floor(F.log2("c")).alias("class")).count().orderBy(F.desc("class")).collect()
    least, total = 1 << 62, 0
    for row in classes:
        total += row["count"]
        if total > limit:
            break
        least = 1 << row["class"]
    top = words.where(F.col("c") >= least).toArrow()
    return Head(top.column("h").to_numpy().view(U64), top.column("c").to_numpy())


def score(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    filter_bits: int = FILTER_BITS,
    prior: float = PRIOR,
    max_head: int = MAX_HEAD,
) -> DataFrame:
    """Scores of all texts by a model of those where ``train`` holds.

    Columns: the key, ``train``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigram log10 probability, from exact
    counts), ``score`` (the model's), ``filter_full`` (share of bits that are set).

    The model smooths a pair's count, read from the filter and never above either
    word's count, by a Dirichlet prior of ``prior`` on the unigrams. Counts of all
    pairs of all training texts go in. The filter's size is fixed, 64 MB by default;
    at ten bits a pair one answer in ten thousand to twenty is a false yes.
    Exact counts of the commonest tokens are broadcast, at most ``max_head`` of them;
    a text's other tokens are joined to their counts, a row a token and text.

    A null or empty text is the end token alone. A row whose ``train`` is null is not
    learned from. Repeated rows are learned from and scored each. Without any training
    text every token is unknown. An empty table gives no rows. Columns of the input
    other than those named are not read. Tokens are told apart by 64 bits of hash.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    learned = rows.where("train").select("text")
    words = store(learned.mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]), int(sums[1])
    sc = docs.sparkSession.sparkContext
    head = sc.broadcast(fit_head(words, max_head))
    wanted = 1 << max(0, math.ceil(math.log2(max(1, n / SEGMENT_NGRAMS))))
    filt = Filter(filter_bits, max(MIN_SEGMENTS, min(MAX_SEGMENTS, wanted)), PROBES)
    shipped = learned.mapInArrow(ship_ngrams(filt, head), "segment int, ones binary, many binary, counts binary")
    segments = store(shipped.groupBy("segment").applyInArrow(fill_segment(filt), "segment int, bits binary, ngrams long"), "filter")
    held = np.zeros(filter_bits // 8, np.uint8)
    size = filt.segment_bits // 8
    for part in segments.select("segment", "bits").toArrow().to_batches():
        for s, b in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            held[s * size : (s + 1) * size] = np.frombuffer(b.as_buffer(), np.uint8)
    full = float(np.bitwise_count(held).sum()) / filter_bits
    bits = sc.broadcast(held)

    kind = docs.select(key).schema[0].dataType.simpleString()
    texts = rows.select("row", "text", "_key", "train").mapInArrow(
        score_texts(filt, bits, head, n, v, prior),
        f"kind int, row long, n long, h long, base double, score double, key {kind}, train boolean",
    )
    keyed = store(texts, "scored")
    bits.destroy()
    head.destroy()
    rare = keyed.where("kind = 1").select("row", "n", "h").join(words, "h")
    added = rare.groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"))
    return (
        keyed.where("kind = 0")
        .join(added, "row", "left")
        .select(
            F.col("key").alias(key),
            "train",
            F.col("n").alias("n_tokens"),
            (F.col("h") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            "score",
            F.lit(full).alias("filter_full"),
        )
    )
