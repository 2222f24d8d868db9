"""Rows sorted by a key, taken some whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, the same for neighbours with equal keys."""
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([np.diff(table.column(k).to_numpy()) != 0 for k in keys], axis=0)
    return np.cumsum(new) - 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``limit`` bytes that hold whole groups, with their group numbers.

    Groups must be bounded: one is never cut. Keys are numbers and not null.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            held.append(batch.slice(lo, 1024))
            size += held[-1].nbytes
            if size < limit:
                continue
            table = pa.Table.from_batches(held)
            numbers = group_numbers(table, keys)
            cut = int(np.searchsorted(numbers, numbers[-1]))
            if cut:
                yield table.slice(0, cut), numbers[:cut]
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, group_numbers(table, keys)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of numbers as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of list that occurs, and those lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(column.take(pa.array(rows)))
