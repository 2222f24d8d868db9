"""Whole batches of texts as one byte array: words, hashes and shingles in numpy.

Hashes are polynomial modulo 2^64 and mixed; a word's hash does not depend on where
the word stands, so all words of a batch are hashed by one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}

U64 = np.uint64


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit words (the finalizer of splitmix64)."""
    h = h + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i below ``n``; kept for the usual chunk size only."""
    size = max(n, CHUNK_BYTES + 1)
    if "up" not in _POWERS or len(_POWERS["up"]) < size:
        made = []
        for base in (BASE, _INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if size > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _POWERS["up"], _POWERS["down"] = made
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of about ``CHUNK_BYTES``, a row never cut."""
    flat, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(flat: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return flat + (((flat >= 65) & (flat <= 90)).view(np.uint8) << 5)


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+`` and the row offsets among the words."""
    solid = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    starts = np.empty(len(flat), bool)
    if len(flat):
        starts[0] = solid[0]
        np.logical_and(solid[1:], ~solid[:-1], out=starts[1:])
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    starts[edges] = solid[edges]
    ends = np.empty(len(flat), bool)
    if len(flat):
        ends[-1] = solid[-1]
        np.logical_and(solid[:-1], ~solid[1:], out=ends[:-1])
    ends[edges - 1] = solid[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def prefix_hash(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial and the inverse powers."""
    up, down = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, U64)
    np.cumsum((flat.astype(U64) + U64(1)) * up[: len(flat)], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; depends on its bytes and length alone."""
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD1342543DE82EF95))


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the row offsets among them."""
    flat = lower(flat)
    first, last, rows = words(flat, offsets)
    return span_hash(*prefix_hash(flat), first, last), rows


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words from each position; the last ``n - 1`` are left out."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out, k) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out, n)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes, offsets)``: each row's distinct ``n``-word shingles, sorted.

    A row with fewer words has its whole sequence as one shingle; a row without
    words has none.
    """
    for lo, hi, flat, offsets in chunks(column):
        hashes, rows = word_hashes(flat, offsets)
        counts = np.diff(rows)
        grams = ngram_hashes(hashes, n)
        owner = np.repeat(np.arange(hi - lo), np.maximum(counts - n + 1, 0))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0), np.maximum(counts - n + 1, 0)) + rows[:-1][owner]
        grams = grams[at]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = []
            for r in short:
                w = hashes[rows[r] : rows[r + 1]]
                whole.append(mix(ngram_hashes(w, len(w)), 1000 + len(w))[0])
            owner, grams = np.concatenate([owner, short]), np.concatenate([grams, np.array(whole, U64)])
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        owner, grams = owner[fresh], grams[fresh]
        yield lo, grams, np.searchsorted(owner, np.arange(hi - lo + 1))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return h.view(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: the concatenated runs."""
    total = int(counts.sum())
    base = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)
