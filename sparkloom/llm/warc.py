"""WARC archives: written and read by Spark, with a capture index that is merged from sorted runs by a loser tree."""

from __future__ import annotations

import base64
import gzip
import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, scratch

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1: 40 hex digits are 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, record): the text of a WARC record of each page.

    Of equal payloads of at least `smallest` bytes the one with the least page_id is a response and the others are
    revisits of it. Null html is an empty payload, a null url is written as an empty one. Repeated rows of one page_id
    with equal payloads are all of the same type. Pages without page_id are always responses.
    """
    p = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    firsts = (
        p.where(F.octet_length("html") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    q = p.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(F.col("first") < F.col("page_id"), F.lit(False)))
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, "html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return q.select(
        "page_id",
        F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
            F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), page, F.lit(f">{CRLF}WARC-Target-URI: "), F.col("url"),
            F.lit(f"{CRLF}WARC-Date: "), when, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
            F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(f">{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(""),
            F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
            block, F.lit(CRLF),
        ).alias("record"),
    )


def write_warc(pages: DataFrame, path: str, smallest: int = 0, per_file: int = 20_000) -> str:
    """Compressed archives of up to `per_file` records below path; a task that is run again replaces its files.

    Each file is one gzip member, so offsets in the index count in what it holds, not in the file itself.
    """
    records(pages, smallest).select(F.col("record").alias("value")).write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


FIELDS = re.compile(rb"^([\w-]+):[ \t]*(.*?)\r?$", re.M)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, header fields by lower-case name, block) of each record, by the lengths the headers state."""
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(b"\r\n\r\n", at) + 4
        fields = {k.lower(): v for k, v in FIELDS.findall(content[at:end])}
        stop = end + int(fields[b"content-length"])
        if stop > len(content):
            raise ValueError(f"the record at {at} is cut off")
        yield at, stop + 4 - at, fields, content[end:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """The host's names in reverse, then path and query: captures of a site, and of a URL, stand together."""
    try:
        u = urlsplit(url.lower())
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


INDEX = "url_key string, date string, page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, file string, offset bigint, length bigint"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives below path: a locally sorted run of each file.

    A response's digest and size are those of the payload as read, and must be those that its headers state; a
    revisit's are the ones it states for the payload that it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
        ident = lambda v: int(m[1]) if (m := re.search(rb"urn:page:(-?\d+)", v)) else None
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for offset, length, fields, block in parse(gzip.decompress(content.as_py()) if file.endswith(".gz") else content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    kind = fields[b"warc-type"].decode()
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, size):
                        raise ValueError(f"{file}: the payload at {offset} is not what its headers state")
                    url = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                    rows.append((url_key(url), fields[b"warc-date"].decode(), ident(fields[b"warc-record-id"]), kind, ident(fields.get(b"warc-refers-to", b"")), digest, size, file.rpartition("/")[2], offset, length))
                rows.sort(key=order)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, INDEX)


def order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def loser_tree(runs: list[Iterator[tuple]], key=order) -> Iterator[tuple]:
    """Merge sorted runs: inner nodes hold the loser of their match, so each row costs one comparison a level."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * max(k, 1)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        left, right = build(2 * node), build(2 * node + 1)
        win, lose = (left, right) if beats(left, right) else (right, left)
        losers[node] = lose
        return win

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = None if heads[winner] is None else key(heads[winner])
        node = (winner + k) // 2
        while node >= 1:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


class Runs:
    """Sorted runs that come one after the other, put aside in a temporary file in chunks, of which one a run is in memory when they are read."""

    def __init__(self, chunk: int = 2_000) -> None:
        self.file, self.chunk, self.places, self.name, self.rows = tempfile.TemporaryFile(), chunk, {}, None, []

    def add(self, name: str, row: tuple) -> None:
        if name != self.name or len(self.rows) == self.chunk:
            self.flush()
        self.name = name
        self.rows.append(row)

    def flush(self) -> None:
        if self.rows:
            self.places.setdefault(self.name, []).append(self.file.seek(0, 2))
            pickle.dump(self.rows, self.file)
            self.rows = []

    def read(self, name: str) -> Iterator[tuple]:
        for at in self.places[name]:
            self.file.seek(at)
            yield from pickle.load(self.file)


def merge_index(index: DataFrame, chunk: int = 2_000) -> DataFrame:
    """The index in global order of url_key, date and page_id, with `position` from 0 in that order.

    Ranges of the whole key are dealt out, so that one host's or one URL's captures can lie in many partitions; each
    partition puts the pieces of the runs (one a file) aside and merges them by a loser tree, with a chunk of each in memory.
    Positions are ranks within a partition and the counts of the partitions before it.
    """
    schema = index.schema.simpleString().removeprefix("struct<").removesuffix(">")
    names, types = index.columns, [pa.string() if t == "string" else pa.int64() for _, t in index.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(chunk)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                runs.add(row[7], row)
        runs.flush()
        merged = loser_tree([runs.read(n) for n in runs.places])
        while rows := list(islice(merged, chunk)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        runs.file.close()

    ranged = index.repartitionByRange(F.col("url_key"), F.col("date"), F.col("page_id")).sortWithinPartitions("file", "url_key", "date", "page_id")
    part = F.shiftright("_at", 33)
    merged = cut(ranged.mapInArrow(run, schema).withColumn("_at", F.monotonically_increasing_id()))
    counts = merged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    placed = merged.join(F.broadcast(before.select("_part", "_before")), part == F.col("_part"))
    return placed.select(*names, (F.col("_before") + F.col("_at") - F.shiftleft(part, 33)).alias("position"))


def captures(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """The contract's columns, and url_key, date and position in the merged index, of each page.

    records and merge_index state the rules for nulls, equal payloads and repeated rows; columns of pages other than
    page_id, url and html are not read, and an empty table gives an empty result.
    """
    path = write_warc(pages, scratch(pages.sparkSession, "warc"), smallest)
    return merge_index(cut(read_warc(pages.sparkSession, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "position")


def op7_warc(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """The contract's columns of captures alone."""
    return captures(pages, smallest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, regexp_replace(lower(coalesce(url, '')), '[\\x00-\\x20]', '%20', 'g') AS url, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)([?][^#]+)?', ['host', 'path', 'query']) AS u FROM d),
g AS (SELECT *, array_to_string(list_reverse(string_split(u.host, '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query AS url_key,
  strftime(TIMESTAMP '1970-01-01' + to_seconds(1700000000 + page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, url_key, date, row_number() OVER (ORDER BY url_key, date, page_id) - 1 AS position FROM g
"""
