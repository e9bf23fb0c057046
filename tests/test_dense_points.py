"""DBSCAN where points have many others in reach, against brute force; cells whose boxes leave the link open; odd coordinates."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster as C


def brute(rows: list[tuple], eps: float = 1.5, least: int = 5) -> dict:
    ok = [r for r in rows if None not in r and all(map(math.isfinite, r[1:]))]
    near = {i: [j for j, p, q in ok if (x - p) * (x - p) + (y - q) * (y - q) <= eps * eps] for i, x, y in ok}
    core = {i for i in near if len(near[i]) >= least}
    label: dict[int, int] = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core]
    return {r[0]: label.get(r[0], min((label[j] for j in near.get(r[0], []) if j in core), default=-1)) for r in rows}


def clumps(gap: float) -> list[tuple]:
    """Two discs of 40 points each of which the rims are so far apart, beside single points, equal points and odd ones."""
    rng, rows = random.Random(5), []
    for at in (0.45, 0.45 + 0.8 + gap):
        for _ in range(40):
            a, r = rng.random() * 2 * math.pi, 0.4 * math.sqrt(rng.random())
            rows.append((at + r * math.cos(a), 0.5 + r * math.sin(a)))
        rows += [(at + 0.4, 0.5), (at - 0.4, 0.5)]
    rows += [(8.0 + 0.7 * k, 8.0) for k in range(6)] + [(-7.0, -7.0)] * 6 + [(-7.0, -8.5), (-0.0, 30.0), (0.0, 30.0)]
    rows += [(None, 0.5), (math.nan, 0.5), (math.inf, 0.5), (0.5, -math.inf)]
    rng.shuffle(rows)
    return [(k, *r) for k, r in enumerate(rows)]


@pytest.mark.parametrize("gap", [1.4, 1.5, 1.5000001])
def test_clumps(spark, gap):
    rows = clumps(gap)
    got = C.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y")
    want = brute(rows)
    assert {r["id"]: r["cluster"] for r in got.collect()} == want
    assert len({want[k] for k, x, y in rows if x is not None and 0 < x < 3.6 and y == 0.5}) == (1 if gap <= 1.5 else 2)


def test_many_in_reach(spark):
    """200,000 points of which each has all others in reach: 4e10 pairs, if pairs were made."""
    dots = spark.range(200_000).select("id", (F.rand(3) * 0.9).alias("x"), (F.rand(4) * 0.9).alias("y"))
    got = C.dbscan(dots, "id", "x", "y").groupBy("cluster").count().collect()
    assert [(r["cluster"], r["count"]) for r in got] == [(0, 200_000)]


def test_crosstab_of_many(spark):
    """Clusters and kinds of 200,000 points, half of them within reach of one another and half elsewhere."""
    dots = spark.range(200_000).select("id", (F.rand(3) * 0.9 + F.col("id") % 2 * 50).alias("x"), (F.rand(4) * 0.9).alias("y"), (F.col("id") % 4).alias("kind"))
    got = C.crosstab(C.dbscan(dots, "id", "x", "y").join(dots.select("id", "kind"), "id"), "cluster", "kind").collect()
    assert {(r["cluster"], r["kind"]): r["n"] for r in got} == {(0, 0): 50_000, (1, 1): 50_000, (0, 2): 50_000, (1, 3): 50_000}


def test_few_jobs(spark):
    """Noise that fills all cells, as the larger customer tables do: sides decide which cells touch, in one task, so that few jobs run."""
    dots = spark.range(60_000).select("id", (F.rand(3) * 12).alias("x"), (F.rand(4) * 12).alias("y")).localCheckpoint()
    spark.sparkContext.setJobGroup("few", "few")
    try:
        got = C.dbscan(dots, "id", "x", "y").groupBy("cluster").count().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["cluster"], r["count"]) for r in got] == [(0, 60_000)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 90


def test_components_in_one_task(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 1), (7, 7), (2, None)]
    edges = spark.createDataFrame(rows, "a long, b long")
    assert sorted(C._components(edges).collect()) == sorted(C.connected_components(edges).collect()) == sorted(C._components(edges, few=0).collect())
    assert C._components(edges.limit(0)).count() == 0
