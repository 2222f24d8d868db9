"""Seeded draws computed from row keys.

A draw depends on its key parts only, never on partitioning, task order or a
retry, so a lost executor cannot change a split or a noise column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digest(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def _digits(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def hash_key(*parts) -> Column:
    """52-bit integer key, exact in a double; for orderings and thresholds."""
    return _digits(_digest(parts), 1, 13)


def uniform(*parts) -> Column:
    """Uniform draw in (0, 1) from the first 32 bits of the digest."""
    return (_digits(_digest(parts), 1, 8) + F.lit(0.5)) / F.lit(2.0**32)


def words(*parts) -> tuple[Column, Column]:
    """Two 31-bit words from one digest, to seed any number of draws in a batch function."""
    digest = _digest(parts)
    mask = F.lit(2**31 - 1).cast("bigint")
    return tuple(_digits(digest, start, 8).bitwiseAND(mask) for start in (1, 9))
