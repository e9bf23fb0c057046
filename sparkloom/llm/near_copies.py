"""Near copies by word shingles: SimHash fingerprints and MinHash bands find candidates, the shingle sets themselves decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut
from .simhash import BITS, keep_least, links

WIDTH, SIMILAR = 5, 0.8
#: Bands of MinHash values and values a band: a pair at similarity 0.8 has no band in common with probability 3e-7.
BANDS, ROWS = 50, 6
#: Members of a bucket of which all pairs are compared; larger ones are compared with two members, and then across what is left apart.
BUCKET = 32
#: Shingles whose values are computed at once, so that one very long text needs no more memory than others.
CHUNK = 2_000
#: Words of 64 bits in a set's mark: 1024 bits tell apart what differs in some hundred elements; larger differences only cost comparisons.
MARK = 16
#: Cells in which shingles are counted to find the rare ones: 8 MB, whatever the input. Those of one cell pass for one, which changes the order only.
CELLS = 1 << 20


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words in lower case, or of the whole text if it is shorter; none if there is no word."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, runs)), ">u8").astype(np.uint64))


def multipliers() -> np.ndarray:
    return np.random.default_rng(8).integers(1 << 62, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    low = np.full(len(odd), np.iinfo(np.uint64).max)
    hashes = hashes ^ (hashes >> np.uint64(32))
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[at : at + CHUNK] * odd).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(low[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(ones * 2 > len(hashes)).tobytes(), ">i8")[0])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, same, keys, fp): a digest of the shingle set, the keys of its bands, and its fingerprint (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = multipliers()
        for b in batches:
            same, keys, fps = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t)
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(band_keys(h, odd) if len(h) else np.zeros(0, np.int64))
                fps.append(set_fingerprint(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["doc_id", "same", "keys", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, same binary, keys array<bigint>, fp bigint")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, set) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.mapInArrow(run, "id bigint, set array<bigint>")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, rep, n, hub, end) of reps (rep, keys): the bands that two or more share, with their number, the least and the greatest of them."""
    rows = reps.select("rep", F.explode("keys").alias("key")).repartition("key")  # the counts and the join need no other shuffle; a key tells its band
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub"), F.max("rep").alias("end")).where("n > 1")
    return cut(rows.join(sizes, "key"))


def candidates(shared: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b, of buckets: all pairs of a bucket, or of a larger one each member with the least and the greatest."""
    x = shared.where(F.col("n") <= bucket).select("key", F.col("rep").alias("a"))
    pairs = x.join(x.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b")
    large = shared.where(F.col("n") > bucket)
    stars = large.select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(large.select(F.col("rep").alias("a"), F.col("end").alias("b")))
    return pairs.unionByName(stars.where("a < b")).distinct()


def simhash_candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b, of reps (rep, fp): operator 8's links of fingerprints that differ in 2 bits or fewer; of equal ones each with the least rep."""
    hubs = cut(reps.where("fp IS NOT NULL").groupBy("fp").agg(F.min("rep").alias("hub")))
    equal = reps.join(hubs, "fp").where("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return links(hubs.select("fp", F.col("hub").alias("rep"))).unionByName(equal)


def apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b) of pairs whose components (node, component) differ."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b").distinct()


def open_members(shared: DataFrame, components: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(id, component) of the members of larger buckets that the comparisons so far left in several components."""
    large = shared.where(F.col("n") > bucket).select("key", "rep")
    known = large.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    split = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return known.join(split, "key").select(F.col("rep").alias("id"), "component").distinct()


def mark(hashes: np.ndarray) -> np.ndarray:
    """MARK words of 64 bits: each bit is the parity of the hashes that fall on it, so two marks differ in no more bits than the sets in elements."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * MARK), minlength=64 * MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def can_be_similar(x: str, y: str) -> Column:
    """Whether sets of these names (struct columns with size and m0, m1, ...) can have similarity SIMILAR: true of all that have it.

    Sets of s elements together that differ in d have similarity (s - d) / (s + d).
    """
    differ = reduce(add, [F.bit_count(F.col(f"{x}.m{k}").bitwiseXOR(F.col(f"{y}.m{k}"))) for k in range(MARK)])
    return differ <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * F.lit((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6


def rarities(sets: DataFrame) -> np.ndarray:
    """How many of all hashes of sets (set) fall on each of CELLS cells: partitions sum first, and the driver gets one number a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(CELLS), minlength=CELLS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["cell", "n"])

    rows = sets.select("set").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CELLS, np.int64)
    n[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return n


def prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, component, size, at, shingle, m0, m1, ...) of sets (id, component, set): the rarest shingles of each, of which every similar set has one.

    The order is by counts and then by hash, the same for all sets; at is the place in it.
    """
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts, rows = held.value, [], 0
        for b in batches:
            for i, component, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                df = n[h % np.uint64(CELLS)]
                at = np.arange(len(h) - math.ceil(SIMILAR * len(h) - 1e-9) + 1 if len(h) else 0)
                first = np.lexsort((h, df))[: len(at)]
                at = at[df[first] > 1]  # a shingle of no other set joins nothing
                part = np.empty((len(names), len(at)), np.int64)
                part[:3] = [[i], [component], [len(h)]]
                part[3], part[4], part[5:] = at, h[first[at]].view(np.int64), mark(h)[:, None]
                parts.append(part)
                rows += len(at)
                if rows >= 20_000:
                    yield packed(parts)
                    parts, rows = [], 0
        if parts:
            yield packed(parts)

    names = ["id", "component", "size", "at", "shingle", *(f"m{k}" for k in range(MARK))]
    return sets.select("id", "component", "set").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def open_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b, of members (id, component): every pair of two components that has similarity SIMILAR, and few others.

    Two such sets share one of their rarest shingles: with n of them, one of the first n - SIMILAR * n, rounded up. At the first one
    that they share, what follows in both must still be enough, and their marks must differ in no more bits than similar sets
    do. Both are conditions of the join, so that near misses, which large groups are full of, do not become rows. What many share is
    rare in no set, so passages common to a bucket make no pairs; nothing is left out.
    """
    sets = cut(shingle_sets(texts.join(members.select("id"), "id", "left_semi").select("id", "text")).dropDuplicates(["id"]).join(members, "id"))
    rows = cut(prefixes(sets, rarities(sets)))
    of = [c for c in rows.columns if c != "shingle"]
    x, y = rows.select("shingle", F.struct(*of).alias("x")), rows.select("shingle", F.struct(*of).alias("y"))
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    enough = rest >= (F.col("x.size") + F.col("y.size")) * F.lit(SIMILAR / (1 + SIMILAR)) - 1e-6
    two = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    near = x.join(y, "shingle").where(two & enough & can_be_similar("x", "y"))
    return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have similarity SIMILAR or above; texts: (id, text)."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(shingle_sets(texts.join(involved, "id", "left_semi").select("id", "text")).dropDuplicates(["id"]))
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.where(both >= SIMILAR * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def near_copy_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over pairs at Jaccard similarity SIMILAR of five-word shingles.

    Equal sets are one node before any join; texts without words form one group. SimHash fingerprints of the sets link what differs in 2 of
    64 bits; at similarity SIMILAR some 10 bits differ, beyond what their index reaches, so MinHash bands add candidates. All are verified: of a fingerprint's links the one with
    the least id at once, the others if they are between components by then. Of a bucket of over `bucket` members each is
    compared with two of them; if that leaves it in several components, the pairs across these are joined on rare shingles. Rows without doc_id get the component
    of equal sets, or null if there is no id in it.
    """
    found = cut(sketches(docs))
    nodes = cut(found.groupBy("same").agg(F.min_by("keys", "doc_id").alias("keys"), F.min_by("fp", "doc_id").alias("fp"), F.min("doc_id").alias("rep")))
    shared = buckets(nodes.where("rep IS NOT NULL").select("rep", "keys"))
    printed = cut(simhash_candidates(nodes.where("rep IS NOT NULL").select("rep", "fp")))
    nearest = printed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    pairs = cut(candidates(shared, bucket).unionByName(nearest).distinct())
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    joined = connected_components(similar(pairs, texts))
    members = cut(open_members(shared, joined, bucket))
    rest = cut(apart(printed, joined).join(pairs, ["a", "b"], "left_anti"))
    if members.limit(1).count():
        rest = cut(rest.unionByName(open_pairs(members, texts)).distinct())
    if rest.limit(1).count():
        more = similar(rest, texts)
        joined = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    roots = nodes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return found.select("doc_id", "same").join(roots, "same").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group; rows without doc_id stay, as do all columns, and of repeated rows the least."""
    return keep_least(docs, cut(near_copy_groups(docs)))
