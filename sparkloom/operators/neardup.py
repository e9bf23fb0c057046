"""Near duplicates: shingle sets, set similarities, MinHash signatures, and banded candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import ratio
from ..session import cut

PRIME = (1 << 31) - 1
#: Shingles that are hashed side by side: with fewer, numpy's calls cost more than its work; the schedule takes 320 bytes of each.
LANES = 1 << 15
SHA1_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
SHA1_ADDED = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)


def shingle_rows(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """(key, shingle), each once."""
    return df.select(key, F.explode(T.shingles(F.col(text), k)).alias("shingle"))


def classes(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, class, set): rows with equal shingle sets form a class, named by its least key; sets are sorted 64-bit hashes.

    Written to the shared folder, as all that follows reads it several times.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(T.shingles(F.col(text), k), lambda s: F.xxhash64(s))))
    d = cut(df.select(key, hashed.alias("set")).withColumn("fp", F.sha2(F.array_join("set", ","), 256)))
    c = d.groupBy("fp").agg(F.min(key).alias("class"))
    return cut(d.join(c, "fp").select(key, "class", "set"))


def representatives(c: DataFrame, key: str) -> DataFrame:
    """(id, set): one row of each class that has shingles."""
    return cut(c.where((F.col(key) == F.col("class")) & (F.size("set") > 0)).select(F.col("class").alias("id"), "set").dropDuplicates(["id"]))


def member_links(c: DataFrame, key: str) -> DataFrame:
    """(a, b, jaccard): each row of a class with its representative, at similarity 1; with the pairs of representatives these give every link."""
    m = c.where((F.col(key) != F.col("class")) & (F.size("set") > 0))
    return m.select(F.col("class").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("jaccard")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, with jaccard."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("jaccard", inter / (F.size("sa") + F.size("sb") - inter)).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def similar_sets(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, members: bool = False) -> DataFrame:
    """(a, b, jaccard) of all pairs of classes with similarity at the threshold or above; exact. members: and of class members with their class.

    Two sets that similar share one of the rarest elements of each: an equi-join on these prefixes, which skips
    elements that many documents hold, and then the true similarity. Elements are counted where they are joined, so the
    rows are shuffled once by element, once by document to be ranked, and the prefixes once more.
    """
    c = classes(df, key, text, k)
    sets = representatives(c, key)
    rows = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("e")).repartition("e")
    counted = rows.join(rows.groupBy("e").agg(F.count("*").alias("df")), "e")
    ranked = counted.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("df", "e")))
    keep = cut(ranked.where((F.col("rn") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("df") > 1)).select("id", "n", "e"))
    a, b = keep.select(F.col("id").alias("a"), F.col("n").alias("na"), "e"), keep.select(F.col("id").alias("b"), F.col("n").alias("nb"), "e")
    cand = a.join(b, "e").where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold).select("a", "b").distinct()
    found = verified(cand, sets, threshold)
    return found.unionByName(member_links(c, key)) if members else found


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, jaccard, containment) of pairs with a common shingle; left and right: (id, shingle), distinct."""
    na, nb = left.groupBy("id").agg(F.count("*").alias("na")), right.groupBy("id").agg(F.count("*").alias("nb"))
    i = left.select(F.col("id").alias("a"), "shingle").join(right.select(F.col("id").alias("b"), "shingle"), "shingle").groupBy("a", "b").agg(F.count("*").alias("i"))
    j = i.join(na.withColumnRenamed("id", "a"), "a").join(nb.withColumnRenamed("id", "b"), "b")
    return j.select("a", "b", ratio(F.col("i"), F.col("na") + F.col("nb") - F.col("i")).alias("jaccard"), ratio(F.col("i"), F.least("na", "nb")).alias("containment"))


def minhash(df: DataFrame, key: str, text: str, k: int = 3, n: int = 100) -> DataFrame:
    """(key, signature): n minima of salted SHA-1 over the shingles, in hexadecimal; `inf` for rows without any."""
    s = df.select(key, F.explode_outer(T.shingles(F.col(text), k)).alias("s"))
    g = s.groupBy(key).agg(*[F.min(F.sha1(F.concat(F.lit(f"{i}_"), F.col("s")).cast("binary"))).alias(f"m{i}") for i in range(n)])
    return g.select(key, F.array(*[F.coalesce(f"m{i}", F.lit("inf")) for i in range(n)]).alias("signature"))


def minhash_fast(df: DataFrame, key: str, text: str, k: int = 3, n: int = 100) -> DataFrame:
    """Likewise from one hash a shingle and n affine maps modulo a prime; stays in generated code."""
    s = df.select(key, F.explode_outer(T.shingles(F.col(text), k)).alias("s")).select(key, F.pmod(F.xxhash64("s"), F.lit(PRIME)).alias("h"), F.col("s").isNull().alias("none"))
    a = [(i * 1_103_515_245 + 12_345) % (PRIME - 1) + 1 for i in range(1, n + 1)]
    g = s.groupBy(key).agg(*[F.min(F.when(~F.col("none"), (F.col("h") * F.lit(x) + F.lit(x % 65_521)) % PRIME)).alias(f"m{i}") for i, x in enumerate(a)])
    return g.select(key, F.array(*[F.coalesce(F.col(f"m{i}").cast("string"), F.lit("inf")) for i in range(n)]).alias("signature"))


def agreement(a, b):
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bands(signatures: DataFrame, key: str, n: int = 20, rows: int = 5) -> DataFrame:
    """(key, band, bucket); signatures of another length are an error."""
    s = F.when(F.size("signature") == n * rows, F.col("signature")).otherwise(F.raise_error(F.lit(f"a signature must have {n * rows} values")).cast("array<string>"))
    cut = F.transform(F.array(s), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.array_join(F.slice(x, b * rows + 1, rows), "|")))[0]
    return signatures.select(key, F.posexplode(cut).alias("band", "bucket"))


def candidates(banded: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b, of rows that share a bucket. Give class representatives: equal texts share all buckets."""
    a, b = banded.select(F.col(key).alias("a"), "band", "bucket"), banded.select(F.col(key).alias("b"), "band", "bucket")
    return a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def minhash_pairs(df: DataFrame, key: str, text: str, k: int = 3, bands: int = 20, rows: int = 5) -> DataFrame:
    """(a, b) as candidates(bands(minhash(.))) has them, of distinct texts named by their least key; exact. Rows without shingles have equal signatures, so each two of them are a pair.

    Shingles are never rows and go to no disk: each task finds minima within its texts. Rows that share a band share its first minimum, so the
    first of each band comes first, and the other four only where another row has the same one (19 % of the bands of sf0.1).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # minima cost time, not bytes
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("fp"), F.col(text).alias("text"))
    kept = docs.groupBy("fp").agg(F.min("id").alias("id"))
    spread = docs.repartition(n, "id")

    def of(wanted: DataFrame) -> DataFrame:
        return spread.join(wanted.repartition(n, "id"), ["id", "fp"]).select("id", "fp", T.shingles(F.col("text"), k).alias("shingles"), "bands")

    everywhere = F.sequence(F.lit(0), F.lit(bands - 1))
    first = cut(least_sha1(of(kept.withColumn("bands", everywhere)), [0], bands, rows))
    one = shared_keys(first, 1)
    wanted = one.groupBy("id").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    rest = least_sha1(of(first.select("id", "fp").distinct().join(wanted, "id")), list(range(1, rows)), bands, rows)
    same = shared_keys(rest, rows - 1, one)
    a, b = same.select(F.col("id").alias("a"), "band", "key"), same.select(F.col("id").alias("b"), "band", "key")
    none = cut(first.where("minima IS NULL").select("id").join(first.where("minima IS NOT NULL").select("id"), "id", "left_anti").distinct())
    empty = none.select(F.col("id").alias("a")).crossJoin(none.select(F.col("id").alias("b"))).where("a < b")
    return a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct().unionByName(empty)


def shared_keys(found: DataFrame, places: int, before: DataFrame | None = None) -> DataFrame:
    """(id, band, key) of the minima of least_sha1, where two ids or more have this key in this band; before: such rows of the places before, whose keys come first."""
    size = 20 * places
    each = found.where("minima IS NOT NULL").select("id", F.posexplode("bands").alias("at", "band"), "minima")
    piece = lambda p: F.expr(f"substring(minima, at * {size} + {20 * p + 1}, 20)")
    parts = each.select("id", "band", *[piece(p).alias(f"m{p}") for p in range(places)])
    mins = parts.groupBy("id", "band").agg(*[F.min(f"m{p}").alias(f"m{p}") for p in range(places)])  # a row may come in pieces
    own = mins.select("id", "band", F.concat(*[f"m{p}" for p in range(places)]).alias("key"))
    if before is not None:
        own = own.join(before.withColumnRenamed("key", "first"), ["id", "band"]).select("id", "band", F.concat("first", "key").alias("key"))
    return cut(own.withColumn("n", F.count("*").over(W.partitionBy("band", "key"))).where("n > 1").select("id", "band", "key"))


def least_sha1(docs: DataFrame, places: list[int], bands: int, rows: int) -> DataFrame:
    """(id, fp, bands, minima) of docs (id, fp, shingles, bands): for each of the bands and each of these places in it, the least salted SHA-1 of the shingles, 20 bytes each.

    A row with many shingles may come in several pieces, and the least of their minima is its own; null for rows without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, wanted, minima = [], [], [], []
            ends = b.column(2).offsets.to_numpy()
            values, lists = b.column(2).values, b.column(3).to_pylist()
            for d in np.flatnonzero(ends[1:] == ends[:-1]).tolist():
                ids.append(d), minima.append(None)
            for at in range(int(ends[0]), int(ends[-1]), LANES):
                to = min(at + LANES, int(ends[-1]))
                d0, d1 = int(np.searchsorted(ends, at, "right")) - 1, int(np.searchsorted(ends, to, "left"))
                cuts = np.clip(ends[d0 : d1 + 1], at, to) - at
                has = np.flatnonzero(cuts[1:] > cuts[:-1])
                own = [lists[d0 + d] for d in has]
                found = piece_minima(values.slice(at, to - at), cuts[:-1][has], own, places, bands, rows)
                ids += (d0 + has).tolist()
                minima += [found[j][w].tobytes() for j, w in enumerate(own)]
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), pa.array(minima, pa.binary())], names=["id", "fp", "bands", "minima"])

    return docs.mapInArrow(run, "id bigint, fp binary, bands array<int>, minima binary")


def piece_minima(values: pa.Array, starts: np.ndarray, wanted: list[list[int]], places: list[int], bands: int, rows: int) -> np.ndarray:
    """Minima of consecutive runs of strings, which begin at starts: bytes by run, band and place; only of wanted bands."""
    found = np.zeros((len(starts), bands, len(places), 20), np.uint8)
    lens = np.diff(np.append(starts, len(values)))
    want = np.zeros((len(starts), bands), bool)
    for j, w in enumerate(wanted):
        want[j, w] = True
    ready, hasher = None, None
    for band in range(bands):
        runs = np.flatnonzero(want[:, band])
        if not len(runs):
            continue
        for p, place in enumerate(places):
            salt = f"{band * rows + place}_".encode()
            if ready is None or ready[0] != len(salt) or not np.array_equal(ready[1], runs):
                some = values if len(runs) == len(starts) else values.take(pa.array(np.flatnonzero(np.repeat(want[:, band], lens))))
                ready, hasher = (len(salt), runs), SaltedSha1(some, len(salt))
            found[runs, band, p] = least(hasher.digests(salt), lens[runs])
    return found


def least(words: list[np.ndarray], lens: np.ndarray) -> np.ndarray:
    """The least digest of each run of so many, as 20 bytes; words: the five of each digest."""
    high = (words[0].astype(np.uint64) << np.uint64(32)) | words[1]
    low = np.minimum.reduceat(high, np.append(0, np.cumsum(lens)[:-1]))
    hit = np.flatnonzero(high == np.repeat(low, lens))
    run = np.searchsorted(np.cumsum(lens), hit, "right")
    order = np.lexsort((words[4][hit], words[3][hit], words[2][hit], run))
    best = hit[order][np.unique(run[order], return_index=True)[1]]
    return np.stack([w[best] for w in words], axis=1).astype(">u4").view(np.uint8).reshape(-1, 20)


class SaltedSha1:
    """SHA-1 of salt + string for many strings at once and salts of one length.

    Strings that fill one block with their salt are hashed side by side, and their schedule is made once: it is linear, so a salt's own one is put in by XOR. Longer ones go to hashlib.
    """

    def __init__(self, strings: pa.Array, salt: int):
        n = len(strings)
        ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
        data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, size = ends - ends[0], np.diff(ends)
        self.long = np.flatnonzero(size + salt > 55)
        self.texts = [data[ends[j] : ends[j + 1]].tobytes() for j in self.long]
        block = np.zeros(n * 64, np.uint8)
        row = np.arange(n) * 64 + salt
        if len(self.long):
            short = np.repeat(size + salt <= 55, size)
            size = np.where(size + salt > 55, 0, size)
            data, ends = data[short], np.append(0, np.cumsum(size))
        block[np.arange(len(data)) + np.repeat(row - ends[:-1], size)] = data
        block[row + size] = 0x80
        bits = (size + salt) * 8
        block[row - salt + 62], block[row - salt + 63] = bits >> 8, bits & 255
        self.w = [np.ascontiguousarray(x) for x in block.view(">u4").reshape(n, 16).T.astype(np.uint32)]
        for t in range(16, 80):
            x = self.w[t - 3] ^ self.w[t - 8]
            x ^= self.w[t - 14]
            x ^= self.w[t - 16]
            self.w.append((x << np.uint32(1)) | (x >> np.uint32(31)))
        self.state = [np.empty(n, np.uint32) for _ in range(7)]

    def digests(self, salt: bytes) -> list[np.ndarray]:
        """The five words of each digest."""
        own = [int.from_bytes(salt.ljust(4, b"\0"), "big")] + [0] * 15
        for t in range(16, 80):
            x = own[t - 3] ^ own[t - 8] ^ own[t - 14] ^ own[t - 16]
            own.append(((x << 1) | (x >> 31)) & 0xFFFFFFFF)
        add, xor, both, either, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
        a, b, c, d, e, x, y = self.state
        for v, h in zip((a, b, c, d, e), SHA1_START):
            v.fill(h)
        for t in range(80):
            add(e, xor(self.w[t], own[t], out=x) if own[t] else self.w[t], out=e)
            add(e, SHA1_ADDED[t // 20], out=e)
            if t < 20:
                xor(both(xor(c, d, out=x), b, out=x), d, out=x)
            elif 40 <= t < 60:
                xor(both(xor(c, d, out=x), b, out=x), both(c, d, out=y), out=x)
            else:
                xor(xor(b, c, out=x), d, out=x)
            add(e, x, out=e)
            add(e, left(a, 5, out=x), out=e)
            add(e, right(a, 27, out=x), out=e)
            left(b, 30, out=x)
            either(right(b, 2, out=b), x, out=b)
            a, b, c, d, e = e, a, b, c, d
        words = [v + np.uint32(h) for v, h in zip((a, b, c, d, e), SHA1_START)]
        if len(self.long):
            digests = np.frombuffer(b"".join(hashlib.sha1(salt + s).digest() for s in self.texts), ">u4").reshape(-1, 5)
            for v, col in zip(words, digests.T):
                v[self.long] = col
        return words


def set_bands(sets: DataFrame, n: int = 20, rows: int = 5) -> DataFrame:
    """(id, band, bucket) of (id, set): minima of n * rows affine maps of the hashes, found within the row; a bucket is a 64-bit hash of its band's minima."""
    a = [(i * 1_103_515_245 + 12_345) % (PRIME - 1) + 1 for i in range(1, n * rows + 1)]
    small = F.transform("set", lambda h: F.pmod(h, F.lit(PRIME)))
    least = lambda v, x: F.array_min(F.transform(v, lambda h: (h * F.lit(x) + F.lit(x % 65_521)) % PRIME))
    buckets = F.transform(F.array(small), lambda v: F.array(*[F.xxhash64(*[least(v, x) for x in a[b * rows : (b + 1) * rows]]) for b in range(n)]))[0]
    return sets.select("id", F.posexplode(buckets).alias("band", "bucket"))


def lsh_similar(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, members: bool = False) -> DataFrame:
    """(a, b, jaccard): banded candidates among class representatives, verified. members: and of class members with their class.

    A pair at the threshold 0.8 has no band of five minima in common with probability (1 - 0.8^5)^20 = 0.0004.
    """
    c = classes(df, key, text, k)
    sets = representatives(c, key)
    spread = sets.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # minima cost time, not bytes
    found = verified(candidates(set_bands(spread), "id"), sets, threshold)
    return found.unionByName(member_links(c, key)) if members else found
