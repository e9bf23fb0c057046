"""Vector expressions over array<double> columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block: so many vectors are broadcast at a time (0.5 KB each at 64 dimensions).
BLOCK = 50_000


def in_blocks(queries: DataFrame, key: str, points: DataFrame) -> DataFrame:
    """Each point with each query. Queries are counted and split by the hash of their key into blocks of about BLOCK rows, of
    which each is broadcast to all points in turn."""
    n = max(1, -(-queries.count() // BLOCK))
    parts = [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else queries for i in range(n)]
    return reduce(DataFrame.unionByName, [points.crossJoin(F.broadcast(q)) for q in parts])


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
