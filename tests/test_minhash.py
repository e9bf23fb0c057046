"""Pairs by shared bands of salted SHA-1 minima: what they write, and their SQL on odd rows."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb
from pyspark.sql import functions as F
from test_oracle import ALL, rows_of

from sparkloom.operators import neardup as D


def written(spark) -> int:
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_shingles_are_not_written(spark):
    r = random.Random(5)
    words = [[f"w{r.randrange(10**6)}" for _ in range(3000)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join(words[0][:-1] + ["else"])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    before = written(spark)
    assert [tuple(x) for x in D.minhash_pairs(df, "id", "text").collect()] == [(0, 12)]
    assert written(spark) - before < sum(map(len, texts))


def test_same_rows_on_odd_rows(spark, tmp_path):
    """Ids of several texts, shingles of more than one block, and equal texts."""
    long = " ".join("x" * 25 + str(k) for k in range(30))
    short = " ".join(f"word{k}" for k in range(30))
    rows = [(1, short), (1, long), (2, short + " more"), (3, long + " more"), (4, long), (5, short + " " + long), (6, "a b"), (6, "a b c"), (7, "x y"), (8, ""), (9, "A b, c"), (None, short + " none"), (10, "\u00e9\u20ac " * 40), (11, "\u00c9\u20ac " * 40)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    q, sql = ALL["lsh_pairs"]
    df, cur = q(spark, str(tmp_path)), con.execute(sql)
    got = rows_of(df.columns, df.collect())
    assert len(got) > 3
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_pieces(spark):
    """Rows with more shingles than are hashed at once, and rows that begin or end within such a run."""
    lists = [[f"s{k}" for k in range(n)] for n in (5, D.LANES + 3, 0, 2, D.LANES)]
    rows = [(j, b"", x, [0, 3]) for j, x in enumerate(lists)]
    docs = spark.createDataFrame(rows, "id long, fp binary, shingles array<string>, bands array<int>").coalesce(1)
    found = D.least_sha1(docs, [1], 20, 5).where("minima IS NOT NULL").select("id", F.expr("substring(minima, 1, 20)").alias("x"), F.expr("substring(minima, 21, 20)").alias("y"))
    got = {r["id"]: (bytes(r["x"]), bytes(r["y"])) for r in found.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()}
    least = lambda x, i: min(hashlib.sha1(f"{i}_{s}".encode()).digest() for s in x)
    assert got == {j: (least(x, 1), least(x, 16)) for j, x in enumerate(lists) if x}
