"""Marks and prefixes: what they rule out is not similar, whatever the sets."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_near_copies import brute_pairs
from test_operators import docs_of

from sparkloom.llm import near_copies


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_marks_differ_no_more_than_sets(common, a, b):
    x, y = common | a, common | b
    differ = np.bitwise_xor(*(near_copies.mark(np.array(sorted(s), np.uint64)) for s in (x, y)))
    assert sum(bin(int(w) & (2**64 - 1)).count("1") for w in differ) <= len(x ^ y)


def test_pairs_about_the_threshold(spark):
    """Groups whose members lie on both sides of 0.8: every similar pair of two components is found, and few others."""
    r = random.Random(9)
    rows = []
    for g, size in enumerate((7, 40, 150, 900)):
        base = [f"{g}b{k}" for k in range(size)]
        for i in range(25):
            w = list(base)
            for k in r.sample(range(size), r.randrange(1 + size // 30)):
                w[k] = f"{g}e{r.randrange(10 * size)}"
            rows.append((100 * g + i, " ".join(w), "a"))
    members = spark.createDataFrame([(i, i) for i, _, _ in rows], "id long, component long")
    got = {tuple(x) for x in near_copies.open_pairs(members, docs_of(spark, rows).selectExpr("doc_id AS id", "text")).collect()}
    want = brute_pairs([x[:2] for x in rows])
    assert want and want <= got and len(got) <= 1.3 * len(want)
    assert near_copies.open_pairs(members.limit(0), docs_of(spark, rows).selectExpr("doc_id AS id", "text")).count() == 0
