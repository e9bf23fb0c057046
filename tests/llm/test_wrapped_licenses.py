"""Licence texts that are wrapped between the two words of a spelling."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from test_operators import SF, docs_of

from sparkloom.llm import licenses
from sparkloom.llm.queries import QUERIES


def test_wrapped_spellings(spark):
    bsd = licenses.TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT\n    OWNER OR")
    mit = licenses.TEXTS["MIT"].replace("sublicense", "sub\nlicense")
    got = licenses.op6_licenses(docs_of(spark, [(1, bsd, "a"), (2, mit, "a")])).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {1: "BSD-3-Clause", 2: "MIT"}


def test_notices(spark):
    mit = licenses.TEXTS["MIT"].replace("\n", " ")
    rows = [
        f"Copyright (c) 2021 X. {mit}", f"Copyright 2021 J. Smith, Acme Inc. and others. All rights reserved. {mit}", f"Copyright: 2018, X\n{mit}", f"Copyright The Authors 2020\n© Me\n{mit}", "Copyright: 2018, X",
        licenses.TEXTS["BSD-2-Clause"].replace(" the above copyright", " the above\ncopyright"), f"Mit License\n\n(C) 1999 Y\n{mit}", f"{mit} more",
    ]
    got = licenses.op6_licenses(docs_of(spark, [(i, t, "a") for i, t in enumerate(rows)])).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "BSD-2-Clause", 6: "MIT", 7: None}


FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the whole texts are not on this machine")
def test_long_licences(spark):
    names = [n for n in licenses.DIGESTS if (FOLDER / n).is_file()]
    rows = [(i, (FOLDER / n).read_text("utf-8", "replace").upper().replace(" ", "  "), "a") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.op6_licenses(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(names))] == names and names


def test_files_match_and_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES["op6_licenses"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(licenses.ORACLE).fetchall(), key=str)
    assert all(r["license_id"] for r in got if r["doc_id"] < 0) and sum(r["doc_id"] < 0 for r in got) == 100
