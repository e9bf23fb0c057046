"""The merged capture index as the query returns it, and pages without ids."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import SF

from sparkloom.llm import warc
from sparkloom.llm.queries import QUERIES


def test_query_order_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = [tuple(r) for r in QUERIES["op7_warc"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(con.execute(warc.ORACLE).fetchall(), key=str)
    by_place = sorted(got, key=lambda r: r[7])
    assert [r[7] for r in by_place] == list(range(len(got)))
    keys = [(r[5], r[6], r[0]) for r in by_place]
    assert keys == sorted(keys)


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_runs_put_aside(chunk):
    r = random.Random(chunk)
    runs, kept = {f"f{k}": sorted((f"u{r.randrange(9)}", "d", r.randrange(99)) for _ in range(r.randrange(12))) for k in range(6)}, warc.Runs(chunk)
    for name, rows in runs.items():
        for row in rows:
            kept.add(name, row)
    kept.flush()
    assert list(warc.loser_tree([kept.read(n) for n in kept.places])) == sorted(x for y in runs.values() for x in y)


def test_odd_pages(spark):
    rows = [(None, "http://a.example/x", "same"), (None, None, "same"), (4, "http://a.example/x", "same"), (2, "http://a.example/x", "same"), (2, "http://a.example/x", "same"), (9, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("digest", "first", "record", "url_key", "Position", "value"):
        pages = pages.withColumn(c, F.lit(1))
    got = warc.captures(pages).collect()
    assert sorted((r["page_id"] is None, r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None) == [(False, 2, "response", None), (False, 2, "response", None), (False, 4, "revisit", 2), (False, 9, "response", None)]
    assert [r["record_type"] for r in got if r["page_id"] is None] == ["response"] * 2 and sorted(r["position"] for r in got) == list(range(6))
    few = warc.write_warc(pages, warc.scratch(spark, "few"), per_file=2)
    assert warc.read_warc(spark, few).count() == 6 and warc.read_warc(spark, few).select("file").distinct().count() >= 3
