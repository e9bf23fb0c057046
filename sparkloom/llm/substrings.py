"""Substring deduplication: windows of consecutive words that also start earlier are found by suffix automata and removed.

Every window of `width` words belongs to the piece of its document in which its smallest hash of `gram` consecutive words
stays the same. Equal windows have equal smallest hashes, so all places of a window lie in pieces with one key, and
pieces can be dealt out by key. Equal pieces (by 128 bits of their words, and the key's 64) are brought together first. Where a key has several distinct pieces, their words
go to the shard of that key, in the order of their first places, and a generalised suffix automaton of the shard gives each
word's matching statistic: the length of the longest run of words ending there that also ends somewhere earlier. A
window is a repeat just if the statistic at its last word is `width` or more.

The reference here is the corpus itself, which has no size bound, so shards are not broadcast: the pieces that can match
a shard are brought to it instead. `match_reference` is the form for a bounded reference; it broadcasts automata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, shared_dir

WIDTH, GRAM = 20, 8
#: Bytes of text whose pieces share a shard, and the words of pieces that share an automaton.
SHARD_BYTES, AUTOMATON_WORDS = 16 << 20, 60_000
#: Distinct pieces of one key beyond which its windows are dealt out one by one.
HOT = 400
#: Pieces of one key that one task may gather; keys with more are dealt out by piece. They are found in a sample of about
#: so many pieces, of all texts alike; how a key is dealt changes no result.
GATHER, SAMPLE = 100_000, 4_000_000
#: Tasks into which shards are dealt; a task takes its shards one after the other.
MOST_TASKS = 50_000
#: Words whose pieces a worker holds before it passes them on; one text may have more.
HELD_WORDS = 1 << 20

PIECE = np.dtype([("key", "<u8"), ("seq", "<u8"), ("alt", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i2")])
#: Two odd bases, one for each half of a piece's 128 bits.
BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def powers(base: np.uint64, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006  grown once a worker
    if len(known.get(base, ())) < n:
        p = np.full(max(n, 4096) * 2, base, np.uint64)
        p[0] = 1
        known[base] = np.multiply.accumulate(p)
    return known[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def spans_hash(sums: np.ndarray, start: np.ndarray, n: int | np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of the runs of n words from start; sums: of words times powers of the base, from prefix_sums."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return mixed((sums[start + n] - sums[start]) * powers(inverse, len(sums))[start])


def prefix_sums(words: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])


def pieces(doc: int, words: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The pieces of one document: key, two hashes of all its words, first word, number of windows."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, PIECE)
    sums = prefix_sums(words)
    g = spans_hash(sums, np.arange(len(words) - gram + 1), gram)
    low, span, m = g, 1, width - gram + 1
    while span * 2 <= m:  # minima over 2, 4, 8 ... hashes
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < m:
        low = np.minimum(low[: len(low) - (m - span)], low[m - span :])
    last = np.append((low[1:] != low[:-1]) | (g[: n - 1] == low[:-1]), True)  # the smallest hash leaves the window, or a smaller one comes
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty(len(starts), PIECE)
    out["key"], out["doc"], out["start"], out["n"] = low[starts], doc, starts, ends - starts
    out["seq"] = spans_hash(sums, starts, ends - starts + (width - 1))
    out["alt"] = spans_hash(prefix_sums(mixed(words), OTHER_BASE), starts, ends - starts + (width - 1), OTHER_BASE)
    return out


def firsts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p by key, words, doc and start, and whether each is the first of its key and words."""
    p = p[np.lexsort((p["start"], p["doc"], p["alt"], p["seq"], p["key"]))]
    new = np.ones(len(p), bool)
    for f in ("key", "seq", "alt"):
        new[1:] = (p[f][1:] != p[f][:-1]) if f == "key" else new[1:] | (p[f][1:] != p[f][:-1])
    return p, new


def squeeze(a: np.ndarray) -> bytes:
    """Fields one after the other, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names), 1)


def unsqueeze(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(blob)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize * len(out)
        out[f] = np.frombuffer(raw, dtype[f], len(out), at)
        at += size
    return out


#: Repeated windows: document, first of them, how many.
MARK = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: Pieces whose words are asked for; hot: window by window.
ASK = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i2"), ("hot", "i1")])
#: Pieces of a key among those sampled.
COUNT = np.dtype([("key", "<u8"), ("n", "<i8")])
#: kind 0: pieces or words for a shard (id); 1: marks, 2: asked pieces, both of a group of documents (id); 3: counts of sampled pieces.
ROW = "kind tinyint, id bigint, data binary"


def rows_of(kind: int, ids: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """A row for each distinct id with its data, which are in no given order."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
    for a, b in zip(cuts, [*cuts[1:], len(ids)]):
        yield kind, int(ids[a]), squeeze(data[a:b])


def marks_of(doc: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    m = np.empty(len(doc), MARK)
    m["doc"], m["start"], m["n"] = doc, start, n
    return m


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group in which what is found about a document travels, so that a task writes a blob a group and not a row a document."""
    return (mixed(doc.astype(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(np.int64)


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int8()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "id", "data"])


class Automaton:
    """A generalised suffix automaton that grows word by word and tells the matching statistic against all before."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.last = [-1], [0], 0

    def add(self, words: list[int]) -> list[int]:
        """The statistic at each word of a new text: the longest run ending there that ends earlier too, in it or before it."""
        nxt, link, length = self.next, self.link, self.len
        last, out = 0, []
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self.split(last, c, q)
                last = q
                out.append(length[q])
                continue
            cur = len(link)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self.split(p, c, q)
            last = cur
            out.append(length[link[cur]])
        return out

    def split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(link)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, words: list[int]) -> list[int]:
        """Matching statistics of a text that is not added."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if (q := nxt[state].get(c)) is not None:
                state, n = q, n + 1
            out.append(n)
        return out


def repeats(shard: Iterable[tuple[int, int, int, np.ndarray]], width: int = WIDTH) -> Iterator[tuple[int, int]]:
    """(doc, start) of the repeated windows among distinct (key, doc, start, words), sorted; automata end between keys."""
    automaton, size, before = Automaton(), 0, None
    for key, doc, start, words in shard:
        if key != before and size > AUTOMATON_WORDS:
            automaton, size = Automaton(), 0
        before = key
        size += len(words)
        for i, n in enumerate(automaton.add(words.tolist())):
            if n >= width:
                yield doc, start + i - width + 1


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(id, data), a row of marks for each document that has repeated windows, and (id, compressed text), of docs (id, text) with distinct ids."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    every = np.uint64(max(1, size // 45 // SAMPLE))  # a piece comes with about 45 bytes of text
    gather = max(GATHER, 40 * int(every))
    tasks = min(shards, MOST_TASKS)  # stated, so that adaptive execution does not put several shards into one task

    def marked(m: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        return rows_of(1, group_of(m["doc"], shards), m)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            for i, t in zip(b.column(0), b.column(1)):  # one text at a time
                w = tokens(t.as_py())
                found.append(pieces(i.as_py(), w, width, gram))
                held += len(w)
                if held >= HELD_WORDS:
                    yield pieces_out(found)
                    found, held = [], 0
            if found:
                yield pieces_out(found)

    def pieces_out(found: list[np.ndarray]) -> pa.RecordBatch:
        p, first = firsts(np.concatenate(found))  # a repeat among those held needs no shuffle
        keys, n = np.unique(p["key"][first & (p["alt"] % every == 0)], return_counts=True)
        sampled = np.empty(len(keys), COUNT)
        sampled["key"], sampled["n"] = keys, n
        return batch_of([*rows_of(0, (p["key"][first] % np.uint64(shards)).astype(np.int64), p[first]), *marked(marks_of(p["doc"][~first], p["start"][~first], p["n"][~first])), *rows_of(3, np.zeros(len(keys), np.int64), sampled)])

    path = scratch(spark, "pieces")
    docs.mapInArrow(cut_up, ROW).write.parquet(path)
    stage1 = spark.read.parquet(path)
    hot_keys = frequent_keys(stage1.where("kind = 3"), gather // int(every))
    own = stage1.where("kind = 0")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the hot keys go to shards of their own, by their words: none gathers a whole key."""
        for b in batches:
            for ident, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = unsqueeze(data, PIECE)
                hot = np.isin(p["key"], hot_keys)
                rows = [*rows_of(0, shards + ((p["seq"] ^ p["alt"])[hot] % np.uint64(shards)).astype(np.int64), p[hot])]
                yield batch_of(rows + ([(0, ident, squeeze(p[~hot]) if hot.any() else data)] if not hot.all() else []))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ident), blobs in by_id(batches):
            p, first = firsts(np.concatenate([unsqueeze(x, PIECE) for x in blobs]))
            out = [*marked(marks_of(p["doc"][~first], p["start"][~first], p["n"][~first]))]
            p = p[first]
            if len(p):
                new = np.append(True, p["key"][1:] != p["key"][:-1])
                count = np.diff(np.append(np.flatnonzero(new), len(p)))[np.cumsum(new) - 1]
                if ident < shards:
                    p, count = p[count > 1], count[count > 1]
                asked = np.empty(len(p), ASK)
                for f in ASK.names[:-1]:
                    asked[f] = p[f]
                asked["hot"] = (count > HOT) | (ident >= shards)
                out += rows_of(2, group_of(p["doc"], shards), asked)
            yield batch_of(out)

    path2 = scratch(spark, "asked")
    (own.mapInArrow(deal, ROW) if len(hot_keys) else own).repartition(tasks, F.col("id")).sortWithinPartitions("id").mapInArrow(sort_out, ROW).write.parquet(path2)
    stage2 = spark.read.parquet(path2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in b.column(1)], pa.binary())], names=["id", "text"])

    texts = docs.mapInArrow(pack, "id bigint, text binary")
    asked = by_document(stage2.where("kind = 2"), ASK)

    def give_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p: list[np.ndarray] = []  # of each document: key, doc, start, number of words
            words: list[np.ndarray] = []
            single: list[np.ndarray] = []
            held = 0
            for row in zip(*b.columns):
                doc, data, text = (x.as_py() for x in row)
                w = tokens(zstandard.decompress(text).decode("utf-8", "surrogatepass"))
                sums, pieces_ = prefix_sums(w), unsqueeze(data, ASK)
                for hot in (0, 1):
                    q = pieces_[pieces_["hot"] == hot]
                    if not len(q):
                        continue
                    starts, lengths, keys = q["start"], q["n"] + np.int32(width - 1), q["key"]
                    if hot:
                        starts = np.concatenate([np.arange(s, s + n) for s, n in zip(q["start"].tolist(), q["n"].tolist())])
                        lengths, keys = np.full(len(starts), width), spans_hash(sums, starts, width)
                    head = np.empty(len(starts), WORDS)
                    head["key"], head["doc"], head["start"], head["len"] = keys, doc, starts, lengths
                    p.append(head)
                    single.append(np.full(len(head), bool(hot)))
                    words += [w[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
                    held += int(lengths.sum())
                if held >= HELD_WORDS:
                    yield words_out(np.concatenate(p), np.concatenate(single), words)
                    p, words, single, held = [], [], [], 0
            if p:
                yield words_out(np.concatenate(p), np.concatenate(single), words)

    def words_out(head: np.ndarray, one: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
        rank = np.lexsort((head["start"], head["doc"], head["key"], one))
        same = (head["key"][rank][1:] == head["key"][rank][:-1]) & one[rank][1:] & one[rank][:-1]
        repeated = rank[np.append(False, same)]  # a hot key's windows that an earlier row has too
        rows = [*marked(marks_of(head["doc"][repeated], head["start"][repeated], 1))]
        left = rank[~np.append(False, same)]
        shard = (head["key"][left] % np.uint64(shards)).astype(np.int64)
        left, shard = left[np.argsort(shard, kind="stable")], np.sort(shard)
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(left)]):
            of = left[x:y]
            body = head[of].tobytes() + np.concatenate([words[i] for i in of.tolist()]).tobytes()
            rows.append((0, int(shard[x]), zstandard.compress(np.int64(len(of)).tobytes() + body, 1)))
        return batch_of(rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, ident), blobs in by_id(batches):
            if kind == 1:
                yield batch_of([(1, ident, x) for x in blobs])
                continue
            found: dict[tuple[int, bytes], tuple[int, int]] = {}  # the words are held once, in the key
            docs_, starts = [], []
            for blob in blobs:
                raw = zstandard.decompress(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                words = np.frombuffer(raw, np.uint64, -1, 8 + n * WORDS.itemsize)
                at = 0
                for key, doc, start, length in np.frombuffer(raw, WORDS, n, 8).tolist():
                    name = (key, words[at : at + length].tobytes())
                    at += length
                    other = found.setdefault(name, (doc, start))
                    if other != (doc, start):  # windows of a hot key: the first one stands for all
                        if (doc, start) < other:
                            found[name] = (doc, start)
                            doc, start = other
                        docs_.append(doc)
                        starts.append(start)
            ordered = sorted(((key, *place, w) for (key, w), place in found.items()), key=lambda x: x[:3])
            del found
            for doc, start in repeats(((*x[:3], np.frombuffer(x[3], np.uint64)) for x in ordered), width):
                docs_.append(doc)
                starts.append(start)
            yield batch_of([*marked(marks_of(np.array(docs_, np.int64), np.array(starts, np.int32), 1))])

    worded = asked.join(texts, "id").select("id", "data", "text").mapInArrow(give_words, ROW)
    path3 = scratch(spark, "matched")
    worded.repartition(tasks, F.col("kind"), F.col("id")).sortWithinPartitions("kind", "id").mapInArrow(match, ROW).write.parquet(path3)
    marks = [x.where("kind = 1") for x in (stage1, stage2, spark.read.parquet(path3))]
    return by_document(marks[0].unionByName(marks[1]).unionByName(marks[2]), MARK), texts


def frequent_keys(counts: DataFrame, limit: int) -> np.ndarray:
    """The keys of which more than `limit` pieces were sampled: at most as many as the sample (SAMPLE) holds limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                c = unsqueeze(data, COUNT)
                yield pa.RecordBatch.from_arrays([pa.array(c["key"].view(np.int64)), pa.array(c["n"])], names=["key", "n"])

    rows = counts.select("data").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array([r["key"] for r in rows.where(F.col("n") > limit).collect()], np.int64).view(np.uint64)


def by_document(rows: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, data): one row for each document, from blobs of groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_id(batches):
            a = np.concatenate([unsqueeze(x, dtype) for x in blobs])
            out = [*rows_of(0, a["doc"], a)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["id", "data"])

    return rows.repartition(F.col("id")).sortWithinPartitions("kind", "id").mapInArrow(run, "id bigint, data binary")


WORDS = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("len", "<i4")])


def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """Rows that are sorted by kind and id, as ((kind, id), data of its rows)."""
    now, blobs = None, []
    for b in batches:
        for *name, data in zip(*(c.to_pylist() for c in b.columns)):
            if name != now and blobs:
                yield tuple(now), blobs
                blobs = []
            now = name
            blobs.append(data)
    if blobs:
        yield tuple(now), blobs


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each row: words in a window that also starts earlier are removed. texts: with the column kept.

    Null and empty texts have no words and nothing is removed. Rows without doc_id come before all others; rows that
    share a doc_id are ordered by their texts, and wholly equal rows are one document of which each row gets the result.
    """
    shared_dir(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        path = scratch(docs.sparkSession, "rows")
        d.groupBy("doc_id", "text").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
        rows = docs.sparkSession.read.parquet(path)
        done = clean(rows.select("id", "text"), width, gram, texts)
        again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_")
        return rows.select("id", "doc_id", "n").join(done, "id").select("doc_id", again, *[c for c in done.columns if c != "id"]).drop("_")
    return clean(d.select(F.col("doc_id").alias("id"), "text"), width, gram, texts).withColumnRenamed("id", "doc_id")


def clean(docs: DataFrame, width: int, gram: int, with_kept: bool = True) -> DataFrame:
    marks, texts = repeated_windows(docs, width, gram)
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *[("kept", pa.string())] * with_kept, ("kept_sha256", pa.string())]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for row in zip(*b.columns):
                ident, text, data = (x.as_py() for x in row)
                words = zstandard.decompress(text).split()
                n = len(words)
                if data:
                    steps = np.zeros(n + 1, np.int64)
                    m = unsqueeze(data, MARK)
                    np.add.at(steps, m["start"], 1)
                    np.add.at(steps, m["start"] + m["n"] + (width - 1), -1)
                    gone = np.cumsum(steps[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                rows.append((ident, n, n - len(words), *[kept.decode("utf-8", "replace")] * with_kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return texts.join(marks, "id", "left").select("id", "text", "data").mapInArrow(finish, f"id bigint, n_words bigint, n_removed bigint, {'kept string, ' * with_kept}kept_sha256 string")


def match_reference(docs: DataFrame, reference: DataFrame, shortest: int = WIDTH, limit: int = 64 << 20) -> DataFrame:
    """(doc_id, start, n_words): maximal runs of at least `shortest` words of docs that also stand in reference texts.

    reference (text) is checked to be at most `limit` bytes and broadcast. A worker builds its automata once, one for
    each AUTOMATON_WORDS words, and every document is streamed through all of them. Null and empty texts have no runs.
    """
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"a reference of {size} bytes is too large to broadcast")
    texts = [r["text"] for r in reference.where("text IS NOT NULL").select("text").collect()]  # checked above
    shared = docs.sparkSession.sparkContext.broadcast({"texts": texts})

    def automata() -> list[Automaton]:
        """Kept with the broadcast value, which a worker holds from task to task."""
        if "automata" not in shared.value:
            built, held = [Automaton()], 0
            for t in shared.value["texts"]:
                w = tokens(t).tolist()
                if held + len(w) > AUTOMATON_WORDS and held:
                    built.append(Automaton())
                    held = 0
                built[-1].add(w)
                held += len(w)
            shared.value["automata"] = built
        return shared.value["automata"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = tokens(text)
                best = np.zeros(len(w), np.int64)
                for a in automata():
                    best = np.maximum(best, np.array(a.statistics(w.tolist()), np.int64))
                for i in range(len(w)):  # a run is maximal if the next word does not lengthen it
                    if best[i] >= shortest and (i + 1 == len(w) or best[i + 1] <= best[i]):
                        out.append((doc, i - int(best[i]) + 1, int(best[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["doc_id", "start", "n_words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, start bigint, n_words bigint")


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats, which states the rules for nulls, empty texts, repeated rows and ids; other
    columns of docs are not read, and an empty table gives an empty result."""
    return remove_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
