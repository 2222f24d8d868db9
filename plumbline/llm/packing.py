"""Bounded-space best-fit packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import bytetext
from plumbline.sources.shared import fresh_path

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
FAN_IN = 64
CACHED_UNITS = 2_000_000
PIECE = "doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class UnitTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins over it.

    Texts are cut where the tokenizer's own words end for certain: at a space, tab or
    line end, and between a plain or Latin-1 letter and ASCII punctuation. Each
    distinct unit is encoded once and its ids are kept, at most ``CACHED_UNITS``; a
    text with the opening of a special token is encoded whole. ASCII case is dropped
    by the tokenizer, so units are compared in lower case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends_word[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def units(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row offsets of the units."""
        space = (flat == 32) | (flat == 9) | (flat == 10) | (flat == 13)
        ascii_letter = (flat >= 97) & (flat <= 122)
        letter_end = ascii_letter.copy()
        if len(flat) > 1:
            latin = (flat[:-1] == 0xC3) & (flat[1:] >= 0xA0) & (flat[1:] <= 0xBF) & (flat[1:] != 0xB7)
            letter_end[1:] |= latin
        mark = (flat > 32) & (flat < 127) & ~ascii_letter & ~((flat >= 48) & (flat <= 57))
        cut = np.zeros(len(flat) + 1, bool)
        if len(flat):
            cut[1:-1] = (letter_end[:-1] & mark[1:]) | space[:-1] | space[1:]
        cut[offsets] = True
        cut[0] = cut[-1] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        solid = ~space[starts] if len(flat) else np.zeros(0, bool)
        starts, ends = starts[solid], ends[solid]
        return starts, ends, np.searchsorted(starts, offsets)

    def learn(self, texts: list[bytes], keys: np.ndarray) -> None:
        """Encode new units; those of letters alone many at a time, as one word each."""
        ids: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            s = t.decode("utf-8", "replace")
            if s.isalpha() and all(c < "Ā" for c in s):
                plain.append((i, s))
            else:
                ids[i] = np.array(self.encode(s), np.uint32)
        for k in range(0, len(plain), 64):
            some = plain[k : k + 64]
            got = np.array(self.encode(" ".join(s for _, s in some)), np.uint32)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) == len(some):
                parts = np.split(got, ends[:-1])
            else:
                parts = [np.array(self.encode(s), np.uint32) for _, s in some]
            for (i, _), part in zip(some, parts, strict=True):
                ids[i] = part
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *ids]).astype(np.uint32)
        keys, at, size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def batch(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, offsets)`` by chunks; every row ends with ``end_id``."""
        for lo, hi, flat, offsets in bytetext.chunks(column):
            raw, flat = flat, bytetext.lower(flat)
            starts, ends, rows = self.units(flat, offsets)
            hashes = bytetext.span_hash(*bytetext.prefix_hash(flat), starts, ends)
            distinct, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHED_UNITS:
                self.clear()
            spot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
            if len(new):
                data = flat.tobytes()
                self.learn([data[starts[i] : ends[i]] for i in first[new]], distinct[new])
            spot = np.searchsorted(self.keys, distinct)[unit]
            size, at = self.size[spot], self.at[spot]
            before = np.concatenate([[0], np.cumsum(size)])[rows]
            ids = self.pool[bytetext.ranges(at, size)] if len(size) else np.zeros(0, np.uint32)
            special = {}
            opening = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
            for r in np.unique(np.searchsorted(offsets, opening, "right") - 1):
                special[int(r)] = np.array(self.encode(raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
            if special:
                parts = [special.get(r, ids[before[r] : before[r + 1]]) for r in range(hi - lo)]
                ids = np.concatenate(parts) if parts else ids
                before = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            counts = np.diff(before) + 1
            out = np.full(int(counts.sum()), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), counts - 1)] = ids
            yield lo, out, np.concatenate([[0], np.cumsum(counts)])


class OpenWindows:
    """At most ``limit`` windows that still take pieces; ``put`` returns what it had to emit."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, piece: tuple, length: int) -> list | None:
        at, full = bisect_left(self.rooms, (length, -1)), None
        if at < len(self.rooms):
            room, name = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.limit:
                full = self.held.pop(self.rooms.pop(0)[1])
            room, name, self.made = self.window, self.made, self.made + 1
            self.held[name] = []
        self.held[name].append((piece, self.window - room, length))
        if room == length:
            done = self.held.pop(name)
            return done if full is None else full + [None] + done
        insort(self.rooms, (room - length, name))
        return full


def _rows(key_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "closed"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def packer(path: str, window: int, limit: int, end_id: int, key_type: pa.DataType) -> Callable:
    """Pack a partition online: rows ``doc_id, text`` in, pieces out, leftovers marked not closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, windows = UnitTokenizer(path), OpenWindows(window, limit)
        part, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def close(pieces: list, closed: bool = True) -> None:
            nonlocal made
            for item in pieces:
                if item is None:
                    made += 1
                    continue
                (doc, start, ids, total), offset, length = item
                rows.append((doc, start, length, ids, total, part + made, offset, closed))
            made += 1

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo, ids, offsets in tokenizer.batch(batch.column(1), end_id):
                for i in range(len(offsets) - 1):
                    own, doc = ids[offsets[i] : offsets[i + 1]], docs[lo + i]
                    total = len(own)
                    whole = total - total % window
                    for start in range(0, whole, window):
                        close([((doc, start, own[start : start + window].tobytes(), total), 0, window)])
                    if whole < total:
                        full = windows.put((doc, whole, own[whole:].tobytes(), total), total - whole)
                        if full:
                            close(full)
                if len(rows) >= 2000:
                    yield _rows(key_type, rows)
                    rows.clear()
        for pieces in windows.held.values():
            close(pieces, closed=False)
        yield _rows(key_type, rows)

    return run


def merger(window: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Fill windows one after the other with leftover pieces, cut where a window ends.

    What remains in the end is handed on, or, in the last round, cut into sequences
    of lengths that are powers of two, which need no padding.
    """

    def run(table: pa.Table) -> pa.Table:
        kind = table.schema.field("doc_id").type
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        total, base = sum(r["length"] for r in rows), (level << 56) + (rows[0]["_group"] << 32)
        sizes = [window] * (total // window)
        rest = total % window
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if last else [rest] * (rest > 0)
        out, k, used = [], 0, 0
        for r in rows:
            done = 0
            while done < r["length"]:
                take = min(sizes[k] - used, r["length"] - done)
                ids = r["ids"][4 * done : 4 * (done + take)]
                out.append((r["doc_id"], r["start"] + done, take, ids, r["doc_tokens"], base + k, used, last or sizes[k] == window))
                done, used = done + take, used + take
                if used == sizes[k]:
                    k, used = k + 1, 0
        return pa.Table.from_batches([_rows(kind, out)])

    return run


def _store(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns ``doc_id, start, length, ids`` (little-endian 32-bit), ``doc_tokens,
    sequence_id, offset``. A document's whole windows are sequences of their own; its
    rest goes to the open window of its partition that it fills best, and when none
    has room the fullest is emitted. Windows open at the end of a partition are merged
    ``FAN_IN`` partitions at a time, cut freely, until one group is left, whose last
    tokens become sequences of power-of-two lengths. Nothing but such leftovers is
    shuffled, at most ``open_windows`` windows a partition.

    A null or empty text is the end token alone; a document longer than a window
    has several pieces; repeated rows are packed each; an empty table gives no rows.
    Other columns are not read. The stored pieces are the output; a lost executor
    loses none of them, and a repeated task numbers its sequences alike, since a
    partition's rows come in the order of the files.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = PIECE.format(key=kind)
    run = packer(tokenizer, window, open_windows, end_id, key_type)
    level, stored = 0, _store(rows.mapInArrow(run, schema + ", closed boolean"), "packed")
    parts = [stored.where("closed")]
    groups = (stored.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    open_rows = stored.where("NOT closed")
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        number = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), 32)
        grouped = open_rows.withColumn("_group", F.floor(number / FAN_IN).cast("long"))
        merged = _store(grouped.groupBy("_group").applyInArrow(merger(window, level, groups == 1), schema + ", closed boolean"), "merged")
        parts.append(merged.where("closed"))
        if groups == 1:
            break
        open_rows = merged.where("NOT closed")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("closed")
