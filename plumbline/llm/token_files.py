"""Token ids of a corpus as flat files of unsigned integers, to be mapped into memory.

A corpus is a folder: ``tokens-00007.bin`` holds the ids of a shard, little-endian, two
bytes each where the vocabulary allows it, else four; ``offsets-00007.bin`` holds 64-bit
places in it, one more than documents; ``corpus.json`` has the width and for each shard
its documents and ids, and those before it. Nothing else is needed to read ids at any place.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.llm import bytetext
from plumbline.llm.packing import UnitTokenizer
from plumbline.llm.storing import store
from plumbline.sources.shared import fresh_path

FILE_BYTES = 1 << 27
BOUND_ROWS = 100
LONG_TEXT = 1 << 20
ROWS_OUT = 4096
BYTES_OUT = 8_000_000
BLANK = re.compile(rb"[ \t\n\r]")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    if re.match("^file:/", folder):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def cut_long(column: pa.Array, limit: int) -> tuple[pa.Array, np.ndarray]:
    """Texts cut after ``limit`` bytes at the next blank, and where each row's pieces begin."""
    flat, offsets = bytetext.buffers(column)
    if len(offsets) < 2 or np.diff(offsets).max() <= limit:
        return column, np.arange(len(offsets))
    edges, counts = [0], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        data, at, before = memoryview(flat[lo:hi]), 0, len(edges)
        while hi - lo - at > limit:
            blank = BLANK.search(data, at + limit)
            if blank is None:
                break
            at = blank.end()
            edges.append(lo + at)
        edges.append(hi)
        counts.append(len(edges) - before)
    data = [pa.py_buffer(np.array(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, *data]), np.concatenate([[0], np.cumsum(counts)])


def place_key(key, row: int) -> tuple:
    """Order of a record: null keys first, equal keys by row."""
    return (key is not None, key if key is not None else 0, row)


def file_bounds(rows: DataFrame, file_bytes: int) -> list[tuple]:
    """Places at which a new file begins, so that files hold about ``file_bytes`` of text each.

    Taken from a hashed sample of about ``BOUND_ROWS`` rows a file, weighted by size. The
    sample decides how large files are and nothing else. One bound a file is on the driver.
    """
    sized = rows.select("key", "row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    files = max(1, -(-total // file_bytes))
    if files == 1:
        return []
    rate = min(1.0, BOUND_ROWS * files / n)
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    sample = sorted((*place_key(r["key"], r["row"]), r["size"]) for r in sized.where(drawn).collect())
    upto = np.cumsum([s[-1] + 1 for s in sample])
    cuts = np.searchsorted(upto, np.arange(1, files) * upto[-1] / files) if sample else []
    return [sample[i][:-1] for i in sorted(set(cuts))]


def encoder(path: str, end_id: int, dtype: str, long_text: int, bounds: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``row, key, text`` to ``shard, row, key, n_tokens, ids``; ``bounds`` are where shards begin."""

    def rows_of(tokenizer: UnitTokenizer, column: pa.Array) -> Iterator[np.ndarray]:
        pieces, first = cut_long(column, long_text)
        last = np.zeros(len(pieces) + 1, bool)
        last[first[1:] - 1] = True
        held: list[np.ndarray] = []
        for lo, ids, offsets in tokenizer.batch(pieces, end_id):
            for i in range(len(offsets) - 1):
                own = ids[offsets[i] : offsets[i + 1]]
                if not last[lo + i]:
                    held.append(own[:-1].astype(dtype))
                    continue
                yield np.concatenate([*held, own]).astype(dtype) if held else own.astype(dtype)
                held = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = UnitTokenizer(path)
        for batch in batches:
            done, held, size = 0, [], 0

            def out() -> pa.RecordBatch:
                part = batch.slice(done, len(held))
                places = zip(part.column("key").to_pylist(), part.column("row").to_pylist(), strict=True)
                shards = pa.array([bisect_right(bounds, place_key(*p)) for p in places], pa.int32())
                counts = pa.array([len(x) for x in held], pa.int64())
                ids = pa.array([x.tobytes() for x in held], pa.binary())
                columns = [shards, part.column("row"), part.column("key"), counts, ids]
                return pa.RecordBatch.from_arrays(columns, ["shard", "row", "key", "n_tokens", "ids"])

            for own in rows_of(tokenizer, batch.column("text")):
                held.append(own)
                size += own.nbytes
                if len(held) == ROWS_OUT or size > BYTES_OUT:
                    yield out()
                    done, held, size = done + len(held), [], 0
            if held:
                yield out()

    return run


class ShardFiles:
    """The two files of a shard while they are written, under the attempt's name until they are whole.

    A task that is repeated, or runs twice, leaves the same files.
    """

    def __init__(self, folder: str, shard: int):
        self.system, base = opened(folder)
        self.system.create_dir(base, recursive=True)
        self.names = [f"{base}/{kind}-{shard:05d}.bin" for kind in ("tokens", "offsets")]
        self.mark = f".{TaskContext.get().taskAttemptId()}"
        self.outs = [self.system.open_output_stream(name + self.mark) for name in self.names]
        self.outs[1].write(np.zeros(1, "<i8").tobytes())
        self.shard, self.documents, self.tokens = shard, 0, 0

    def write(self, ids: pa.Array, counts: np.ndarray) -> None:
        flat, _ = bytetext.buffers(ids)
        ends = self.tokens + np.cumsum(counts)
        self.outs[0].write(pa.py_buffer(np.ascontiguousarray(flat)))
        self.outs[1].write(ends.astype("<i8").tobytes())
        self.documents, self.tokens = self.documents + len(counts), int(ends[-1])

    def close(self) -> None:
        for out, name in zip(self.outs, self.names, strict=True):
            out.close()
            self.system.move(name + self.mark, name)


def shard_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write rows sorted by shard and place to the shards' files; give ``shard, nth, key, n_tokens`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: ShardFiles | None = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
                if lo == hi:
                    continue
                if files is None or files.shard != shards[lo]:
                    if files:
                        files.close()
                    files = ShardFiles(folder, int(shards[lo]))
                part, first = batch.slice(lo, hi - lo), files.documents
                files.write(part.column("ids"), part.column("n_tokens").to_numpy(zero_copy_only=False))
                nth = pa.array(np.arange(first, files.documents, dtype=np.int64))
                columns = [part.column("shard"), nth, part.column("key"), part.column("n_tokens")]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "nth", "key", "n_tokens"])
        if files:
            files.close()

    return run


class _Numbers:
    """A file of numbers: mapped where the file system is local, read by ranges elsewhere."""

    def __init__(self, system: fs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        local = isinstance(system, fs.LocalFileSystem)
        self.mapped = np.memmap(path, self.dtype, "r") if local else None
        self.file = None if local else system.open_input_file(path)

    def __call__(self, lo: int, hi: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[lo:hi]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * size, lo * size), self.dtype)


@dataclass
class Corpus:
    """A written corpus. ``shards`` has ``shard, documents, tokens, first_document, first_token`` of each file."""

    folder: str
    dtype: str
    shards: list[dict]
    _files: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def open(cls, folder: str) -> Corpus:
        system, base = opened(folder)
        with system.open_input_stream(f"{base}/corpus.json") as f:
            return cls(folder, **json.loads(f.read()))

    def save(self) -> None:
        system, base = opened(self.folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/corpus.json") as f:
            f.write(json.dumps({"dtype": self.dtype, "shards": self.shards}).encode())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_files": {}}

    @property
    def n_tokens(self) -> int:
        return sum(s["tokens"] for s in self.shards)

    @property
    def n_documents(self) -> int:
        return sum(s["documents"] for s in self.shards)

    def numbers(self, kind: str, shard: int) -> _Numbers:
        if (kind, shard) not in self._files:
            system, base = opened(self.folder)
            path = f"{base}/{kind}-{shard:05d}.bin"
            self._files[kind, shard] = _Numbers(system, path, "<i8" if kind == "offsets" else self.dtype)
        return self._files[kind, shard]

    def release(self) -> None:
        self._files.clear()

    def window(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from place ``start`` of the whole corpus, over the ends of files; fewer at its end."""
        firsts, parts = [s["first_token"] for s in self.shards], []
        at = max(bisect_right(firsts, start) - 1, 0)
        while length > 0 and at < len(self.shards):
            shard = self.shards[at]
            lo = start - shard["first_token"]
            hi = min(lo + length, shard["tokens"])
            parts.append(self.numbers("tokens", shard["shard"])(lo, hi))
            start, length, at = start + hi - lo, length - (hi - lo), at + 1
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype)

    def document(self, number: int) -> np.ndarray:
        """Ids of the document of that number, from 0."""
        at = bisect_right([s["first_document"] for s in self.shards], number) - 1
        shard = self.shards[at]
        nth = number - shard["first_document"]
        lo, hi = self.numbers("offsets", shard["shard"])(nth, nth + 2).tolist()
        return self.numbers("tokens", shard["shard"])(lo, hi)


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    file_bytes: int = FILE_BYTES,
) -> tuple[Corpus, DataFrame]:
    """Write all texts in ascending order of key as a corpus; also its index ``shard, nth, key, n_tokens``.

    Texts are encoded where they lie; only ids are shuffled, once, to the file that their key
    belongs to. Files hold about ``file_bytes`` of text and are streamed to in order, so no
    task holds one; where each begins is found from the sizes of a sample of rows.
    The bases of the files are prefix sums over their counts, one row a file. A lost
    executor costs the encoding of what it held; files are moved to their name when whole.

    A null or empty text is the end token alone. Null keys come first, rows of equal key
    in the order they are stored in, each with its own ids; a key with a third of all
    rows spans several files. An empty table gives a corpus without files. Texts over
    ``LONG_TEXT`` bytes are encoded in pieces cut at blanks, over which the tokenizer
    never joins. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "corpus")
    dtype = "<u2" if max(len(UnitTokenizer(tokenizer).ends_word) - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    bounds = file_bounds(rows, file_bytes)
    run = encoder(tokenizer, end_id, dtype, LONG_TEXT, bounds)
    encoded = rows.mapInArrow(run, f"shard int, row long, key {kind}, n_tokens long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", "row").drop("row")
    index = store(ordered.mapInArrow(shard_writer(folder), f"shard int, nth long, key {kind}, n_tokens long"), "index")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = index.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    bases = counts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c[:-1]}") for c in ("documents", "tokens")])
    corpus = Corpus(folder, dtype, [r.asDict() for r in bases.orderBy("shard").collect()])
    corpus.save()
    return corpus, index


def reader(corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``shard, nth, key`` to ``key, start, n_tokens, ids`` (little-endian 32-bit), read from the files."""
    firsts = {s["shard"]: s["first_token"] for s in corpus.shards}

    def out(keys: pa.Array, starts: list[int], counts: list[int], ids: list[bytes]) -> pa.RecordBatch:
        columns = [keys, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = -1
        for batch in batches:
            starts, counts, ids, done, size = [], [], [], 0, 0
            for shard, nth in zip(batch.column("shard").to_pylist(), batch.column("nth").to_pylist(), strict=True):
                if shard != held:
                    corpus.release()
                    held, tokens, offsets = shard, corpus.numbers("tokens", shard), corpus.numbers("offsets", shard)
                lo, hi = offsets(nth, nth + 2).tolist()
                starts.append(firsts[shard] + lo)
                counts.append(hi - lo)
                ids.append(tokens(lo, hi).astype("<u4").tobytes())
                size += 4 * (hi - lo)
                if size > BYTES_OUT:
                    yield out(batch.column("key").slice(done, len(ids)), starts, counts, ids)
                    starts, counts, ids, done, size = [], [], [], done + len(ids), 0
            if ids:
                yield out(batch.column("key").slice(done, len(ids)), starts, counts, ids)

    return run


def read(spark: SparkSession, corpus: Corpus, index: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` of every document of the index, from the mapped files.

    ``start`` counts the ids of all documents before it in the corpus.
    """
    kind = index.schema["key"].dataType.simpleString()
    return index.select("shard", "nth", "key").mapInArrow(reader(corpus), f"key {kind}, start long, n_tokens long, ids binary")
