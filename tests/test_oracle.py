"""Every query with an SQL twin gives the same rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

from sparkloom.plans import tabular, textual

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = tabular.Q | textual.Q


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v).removesuffix(" 00:00:00")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_same_rows(spark, duck, name):
    q, sql = ALL[name]
    df = q(spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if not sql])
def test_runs(spark, name):
    assert ALL[name][0](spark, SF).count() >= 1
