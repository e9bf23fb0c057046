"""The SimHash step of the pipeline's near copies by itself: its fingerprints, its links, and that they are verified."""

from __future__ import annotations

import random

from test_operators import SF

from sparkloom.llm import near_copies


def variants() -> list[tuple[int, str]]:
    """Long texts, each with one word changed, and one with half of it changed."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows: list[tuple[int, str]] = []
    for k in range(12):
        w = [word() for _ in range(3_000)]
        other = [*w[:-1], "changed"]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(w[:1_500] + [word() for _ in range(1_500)]))]
    return rows


def test_fingerprints_link_without_bands(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "candidates", lambda shared, bucket: shared.sparkSession.createDataFrame([], "a long, b long"))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(variants(), "doc_id long, text string")).collect()}
    assert sum(got[3 * k + 1] == 3 * k for k in range(12)) >= 10  # one word of 3,000: 2 bits or fewer
    assert all(got[3 * k + 2] == 3 * k + 2 for k in range(12))


def test_links_of_given_documents(spark):
    """Components over 2 of 64 bits equal brute force on the fingerprints."""
    found = near_copies.sketches(spark.read.parquet(f"{SF}/documents.parquet")).where("fp IS NOT NULL").groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "rep")
    rows = [(r["rep"], r["fp"] & (2**64 - 1)) for r in found.collect()]
    want = {(min(i, j), max(i, j)) for n, (i, x) in enumerate(rows) for j, y in rows[:n] if (x ^ y).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in near_copies.simhash_candidates(found).distinct().collect()} == want
