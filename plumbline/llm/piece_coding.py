"""SentencePiece encoding by batched Viterbi in numpy, and decoding.

A text is escaped as its model says (a space in front, spaces as the space mark) and
cut before each mark. No piece that can win has a mark but in front, so the best
segmentation of a text is that of its words. Each distinct word is segmented once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import bytetext

MARK = "▁"
NEVER = -1e8
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 1_000_000
CELLS = 1_000_000
DECODED_IDS = 300_000


class Pieces:
    """Pieces of a model as sorted hash keys with scores and ids; the mark counts as one space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        texts, ids, scores = [], [], []
        raw: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(piece.replace(MARK, " ").encode())
                if model.get_score(i) > NEVER:
                    texts.append(raw[-1])
                    ids.append(i)
                    scores.append(model.get_score(i))
        if any(b" " in t[1:] for t in texts):
            raise ValueError("pieces with a space mark inside are not supported")
        self.unknown_id = model.unk_id()
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        self.longest = max(map(len, texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        keys = bytetext.span_hash(*bytetext.prefix_hash(flat), ends - [len(t) for t in texts], ends)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids, np.int32)[order], np.array(scores)[order]
        size = np.array([len(r) for r in raw], np.int64)
        self.raw, self.raw_size, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), size, np.cumsum(size) - size

    def segment(self, flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of words of ``n`` bytes: ids one after the other, and how many each has.

        Highest sum of scores; of equals the one whose last piece is longest, then the
        one before it, and so on. A character that no piece is made of costs more than
        any piece and becomes its bytes.
        """
        k, reach = len(starts), min(n, self.longest)
        sums, down = bytetext.prefix_hash(flat)
        at = np.arange(n)
        best = np.full((k, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((k, n + 1), np.int64), np.full((k, n + 1), -1, np.int32)
        first = flat[starts[:, None] + at]
        width = np.where(first < 0x80, 1, np.where(first < 0xC0, 0, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))))
        for end in range(1, n + 1):
            lengths = np.arange(min(end, reach), 0, -1)
            begin = starts[:, None] + (end - lengths)
            h = bytetext.span_hash(sums, down, begin, np.broadcast_to((starts + end)[:, None], begin.shape))
            spot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[spot] == h
            value = np.where(hit, self.scores[spot], -np.inf)
            whole = ~hit & (width[:, end - lengths] == lengths)
            value[whole] = self.unknown_score
            value += best[:, end - lengths]
            choice = np.argmax(value, axis=1)
            rows = np.arange(k)
            best[:, end] = value[rows, choice]
            back[:, end] = end - lengths[choice]
            piece[:, end] = np.where(hit[rows, choice], self.ids[spot[rows, choice]], -1)
        return self._trace(first, back, piece, n)

    def _trace(self, first: np.ndarray, back: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = len(first)
        out, place = np.zeros((k, n), np.int32), np.full(k, n)
        used = np.zeros((k, n), bool)
        end, rows = np.full(k, n), np.arange(k)
        while len(rows):
            start, ids = back[rows, end[rows]], piece[rows, end[rows]]
            known = ids >= 0
            place[rows[known]] -= 1
            out[rows[known], place[rows[known]]] = ids[known]
            used[rows[known], place[rows[known]]] = True
            for r, s in zip(rows[~known], start[~known], strict=True):
                spelled = self.byte_ids[first[r, s : end[r]]]
                spelled = spelled if (spelled >= 0).all() else np.array([self.unknown_id], np.int32)
                place[r] -= len(spelled)
                out[r, place[r] : place[r] + len(spelled)] = spelled
                used[r, place[r] : place[r] + len(spelled)] = True
            end[rows] = start
            rows = rows[start > 0]
        return out[used], used.sum(axis=1)


    def texts(self, column: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        good = (flat >= 0) & (flat < len(self.raw_size))
        flat = np.where(good, flat, 0)
        width = np.where(good, self.raw_size[flat], 0)
        whole = self.raw[bytetext.ranges(self.raw_at[flat], width)].tobytes()
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        found = [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array([t[1:] if t[:1] == " " else t for t in found], pa.string())


class Encoder:
    """Ids of whole texts, with the ids of words already segmented, at most ``CACHED_WORDS``."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        ids, sizes, order = [self.pool], [], []
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            step = max(1, CELLS // (int(n) * min(int(n), self.pieces.longest)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                local = np.arange(len(some)) * n
                words = flat[starts[some][:, None] + np.arange(n)].ravel()
                got, size = self.pieces.segment(words, local, int(n))
                ids.append(got)
                sizes.append(size)
                order.append(some)
        size, rows = np.concatenate(sizes), np.concatenate(order)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(ids)
        merged = [np.concatenate(x) for x in ((self.keys, keys[rows]), (self.at, at), (self.size, size))]
        by = np.argsort(merged[0])
        self.keys, self.at, self.size = (m[by] for m in merged)

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(ids, offsets)`` by chunks; an empty text has none."""
        column = pa.compute.replace_substring(column, MARK, " ")
        column = pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(column), 0), "", pa.compute.binary_join_element_wise("", column, " "))
        for _, _, flat, offsets in bytetext.chunks(column):
            cut = flat == 32
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(flat))
            hashes = bytetext.span_hash(*bytetext.prefix_hash(flat), starts, ends)
            distinct, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHED_WORDS:
                self.clear()
            spot = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
            if len(new):
                self.learn(distinct[new], flat, starts[first[new]], (ends - starts)[first[new]])
            spot = np.searchsorted(self.keys, distinct)[unit]
            size, at = self.size[spot], self.at[spot]
            before = np.concatenate([[0], np.cumsum(size)])
            yield self.pool[bytetext.ranges(at, size)], before[np.searchsorted(starts, offsets)]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The input with ``ids``, the text's piece ids (array<int>), in place of any column of that name.

    A null or empty text has no ids. The best segmentation is the one of highest summed
    score, whatever kind the model is: a model of merges keeps its pieces and scores,
    but the order of its merges plays no part. Characters without a piece become
    bytes. Words of any length are segmented whole. Repeated rows are encoded alike; an
    empty table gives no rows.
    """
    own = [c for c in docs.columns if c != ids]
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            done = 0
            for some, offsets in encoder.batch(batch.column(at).cast(pa.string()).fill_null("")):
                part = batch.slice(done, len(offsets) - 1)
                done += len(offsets) - 1
                found = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(some[offsets[0] : offsets[-1]]))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*own, ids])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def decode(coded: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The input with ``decoded``, the text of the ids, in place of any column of that name.

    Marks become spaces and the one in front is dropped; bytes that are no UTF-8 become
    the replacement character; null or unknown ids are empty. A null array is an empty text.
    """
    own = [c for c in coded.columns if c != decoded]
    at = own.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + DECODED_IDS, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pieces.texts(part.column(at))], [*own, decoded])
                lo = hi

    kinds = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in own)
    return coded.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, f"{kinds}, `{decoded}` string")
