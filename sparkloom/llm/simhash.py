"""SimHash near-duplicate groups: fingerprints, deletion-variant index, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut

BITS = 64
#: Shingles whose bits are counted at once, so that one very long text needs no more memory than others.
CHUNK = 50_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> bytes:
    """8 bytes, most significant first: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
        n = len(words) - width + 1
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = b"".join([digest(s, seed) for _, s in zip(range(min(CHUNK, n - at)), shingles)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp bigint) of each row; a null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint(t, width, seed) for t in b.column(1).to_pylist())
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, fp bigint"
    )


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame, bucket: int = 32) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints at 2 or fewer differing bits; fps: distinct (fp, rep).

    A fingerprint is cut into two halves: of two differing bits, one half holds one at most. Each half is indexed under its
    32 one-wildcard variants; an equality join finds the candidates and the bit count verifies them. A variant that more
    than `bucket` fingerprints share would give the square of its size in pairs. Its members are joined on the points at
    one bit or none instead: two fingerprints have such a point in common just if they differ in 2 bits or fewer, and
    each point links its members to the smallest one, which is exact and linear.
    """
    one = F.lit(1).cast("bigint")

    def wildcards(segment: int) -> Column:
        """Keys of one half: its number, the wildcard's place, and the half with that bit cleared."""
        value = F.shiftrightunsigned("fp", 32) if segment == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: (i + 32 * segment) * F.lit(1 << 32) + value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i))),
        )

    variants = fps.select("fp", "rep", F.explode(F.concat(wildcards(0), wildcards(1))).alias("key"))
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(variants.join(sizes, "key").select("key", "fp", "rep", (F.col("n") > bucket).alias("big")))

    small = shared.where("NOT big")
    x, y = small.select("key", F.col("fp").alias("fa"), F.col("rep").alias("a")), small.select("key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    pairs = x.join(y, "key").where(F.col("a") < F.col("b")).where(F.bit_count(differ) <= 2).select("a", "b").distinct()

    points = (
        shared.where("big")
        .select("fp", "rep")
        .distinct()
        .select(
            "rep",
            F.explode(
                F.concat(
                    F.array("fp"),
                    F.transform(
                        F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i)),
                    ),
                )
            ).alias("point"),
        )
    )
    hubs = points.groupBy("point").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = points.join(hubs, "point").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, fingerprint hex, component_id): component_id is the smallest doc_id reachable over links.

    Equal fingerprints are brought together before any join, so copies never become pairs. Null or empty texts have
    fingerprint zero and link like any other; rows without doc_id keep their fingerprint and get the component of equal
    fingerprints, or null if there is no id in it. Repeated rows are kept. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width, seed))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(reps.where("rep IS NOT NULL")))
    roots = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(roots, "fp").select("doc_id", "fp", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of their group, as drop_near_duplicates says."""
    own = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    own = cut(own)
    kept = docs.join(own.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if own.where("n > 1").limit(1).count():
        repeated = own.where("n > 1").select("doc_id")
        least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(least)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def drop_near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """The document with the smallest doc_id of each group; rows without doc_id stay, as do all columns.

    Of repeated rows of one doc_id the least one stays, by all columns in their order.
    """
    return keep_least(docs, cut(simhash_groups(docs, width, seed)))


def op8_simhash(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")
