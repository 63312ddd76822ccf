"""Deterministic randomness from MD5: the same in every engine, partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), key))


def uniform(seed: int, key: Column) -> Column:
    """In [0, 1): the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def normal(seed: int, key: Column) -> Column:
    """Standard normal, by the Box-Muller transform of two uniforms of the same digest."""
    h = digest(seed, key)
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32 + 1)
    u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def hashed(*key: Column) -> Column:
    """A 64-bit hash of the parts joined by |; functions/controls.py computes the same."""
    return F.xxhash64(F.concat_ws("|", *key))


def hashed_uniform(*key: Column) -> Column:
    """In [0, 1), from hashed()."""
    return F.shiftrightunsigned(hashed(*key), 11).cast("double") / F.lit(2.0**53)
