"""Near copies of the pipeline against brute force on the given documents."""

from __future__ import annotations

import random

import pytest
from test_operators import SF, docs_of, messy

from sparkloom.llm import near_copies


def brute_pairs(rows, k=5, threshold=0.8):
    """(a, b) at the threshold, by an index of all shingles."""
    sets, index, both = {}, {}, {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        for s in sets[i]:
            for j in index.setdefault(s, []):
                both[j, i] = both.get((j, i), 0) + 1
            index[s].append(i)
    return {p for p, n in both.items() if n >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}


def roots(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_given_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in d.collect())
    pairs = brute_pairs(rows)
    text = dict(rows)
    assert sum(text[a] != text[b] for a, b in pairs) >= 5
    want = roots([i for i, _ in rows], pairs)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(d).collect()} == {i for i in want if want[i] == i}


@pytest.mark.parametrize("bucket", [0, 32])
def test_large_groups(spark, bucket):
    r = random.Random(6)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(150)] for _ in range(3)]
    rows = []
    for i in range(150):
        w = list(base[i % 3])
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "a"))
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_copy_groups(docs_of(spark, rows), bucket).collect()}
    assert got == roots(range(150), brute_pairs([x[:2] for x in rows])) and set(got.values()) == {0, 1, 2}


def test_messy(spark):
    got = [r["doc_id"] for r in near_copies.drop_near_copies(messy(spark)).collect()]
    assert sorted(i for i in got if i is not None) == [1, 2, 4, 6] and got.count(None) == 2
