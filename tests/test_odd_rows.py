"""Queries against their SQL on a few odd rows that the given tables lack."""

from __future__ import annotations

import duckdb
import pytest
from test_oracle import ALL, rows_of

TEXTS = ["éles x", "lesé", "tables", "les_", "9des", "POUR", "a-les.", "les thing?", "thing d’éles und des", "", None]
LONG = " ".join(f"word{k}" for k in range(60))
DOCS = [LONG, LONG + " more", LONG.replace("word30", "else"), "two words", "one", "", None, "a b c", "A b c.", LONG, " ".join(f"other{k}" for k in range(40))]
ROWS = {"documents": ([(k, x) for k, x in enumerate(DOCS)], "doc_id long, text string"), "conversations": ([(k, 0, "user", x) for k, x in enumerate(TEXTS)], "conv_id long, turn long, role string, text string")}


@pytest.mark.parametrize("name", ["lf_histogram", "lf_votes", "lf_routes", "lsh_pairs"])
def test_same_rows(spark, tmp_path, name):
    con = duckdb.connect()
    for t, (rows, schema) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    q, sql = ALL[name]
    df, cur = q(spark, str(tmp_path)), con.execute(sql)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


DOTTED = ["\u0130les", "x\u0130les", "A\u0130LES b", "th\u0130ng", "TH\u0130NG?", "can \u0130 go", "T\u0130ON OF", "les \u0130", "\u0130 les"]


def dotted(spark, folder, name):
    """Rows of the query and of its SQL on capital i with a dot, which is one letter in lower case there, and two signs in Java."""
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(DOTTED)], ROWS["conversations"][1]).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    q, sql = ALL[name]
    df, cur = q(spark, str(folder)), con.execute(sql)
    return rows_of(df.columns, df.collect()), rows_of([c[0] for c in cur.description], cur.fetchall())


def test_dotted_votes(spark, tmp_path):
    got, want = dotted(spark, tmp_path, "lf_votes")
    assert got == want


def test_dotted_routes(spark, tmp_path):
    got, want = dotted(spark, tmp_path, "lf_routes")
    assert got == want


@pytest.mark.parametrize("language", ["tr", "az", "lt"])
def test_routes_in_locales(spark, tmp_path, language):
    """Capital letters i have other lower cases in these locales' Java, and the same in SQL."""
    texts = ["les THING \u00e9", "NATION OF \u00e9", "Can I go \u00e9", "CAN \u00cd go", "LES\u00cc", "des\u0128 x", "\u012e\u0301 POUR", "TH\u0130NG"]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(texts)], ROWS["conversations"][1]).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    q, sql = ALL["lf_routes"]
    locale = spark.sparkContext._jvm.java.util.Locale
    before = locale.getDefault()
    locale.setDefault(locale(language))
    try:
        df = q(spark, str(tmp_path))
        got = rows_of(df.columns, df.collect())
    finally:
        locale.setDefault(before)
    cur = con.execute(sql)
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
