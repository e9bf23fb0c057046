"""Text identity: fingerprint groups, registries, Bloom filters, weak hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exact_groups(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """(fingerprint, n, first_id): groups of rows with equal clean text."""
    return df.groupBy(T.fingerprint(F.col(text), strict).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))


def in_registry(df: DataFrame, registry: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """df with known: whether the fingerprint of its text is that of a row of the registry (column text)."""
    known = registry.select(T.fingerprint(F.col("text"), strict).alias("_fp")).where("_fp IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    d = df.withColumn("_fp", T.fingerprint(F.col(text), strict))
    return d.join(known, "_fp", "left").withColumn("known", F.coalesce("_in", F.lit(False))).drop("_fp", "_in")


def bloom_bits(df: DataFrame, text: str, capacity: int = 500, hashes: int = 3) -> DataFrame:
    """(bit) of each bit set: at most `capacity` rows, whatever the input."""
    return df.select(F.explode(T.bloom_indices(F.col(text), capacity, hashes)).alias("bit")).distinct()


def bloom_contains(df: DataFrame, bits: DataFrame, text: str, capacity: int = 500, hashes: int = 3) -> DataFrame:
    """df with maybe: whether all bits of its text are set. The bits are one array of at most `capacity` numbers, broadcast."""
    packed = bits.agg(F.array_sort(F.collect_set("bit")).alias("_bits"))
    return df.crossJoin(F.broadcast(packed)).withColumn("maybe", F.forall(T.bloom_indices(F.col(text), capacity, hashes), lambda i: F.array_contains("_bits", i))).drop("_bits")


def weak_collisions(df: DataFrame, text: str, modulus: int = 256) -> DataFrame:
    """(h, n): hash values that two or more distinct texts share; at most `modulus` rows."""
    d = df.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct().select(T.weak_hash(F.col("t"), modulus).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
