"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, and the default where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def hash_order(seed: str, *keys: str) -> Column:
    """A pseudo-random order that any engine with MD5 repeats."""
    return F.md5(F.concat_ws("_", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from MD5 of seed_key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
