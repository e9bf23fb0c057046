"""Large buckets: links that neither their least nor their greatest member has."""

from __future__ import annotations

import random

from test_near_copies import brute_pairs, roots
from test_operators import docs_of

from sparkloom.llm import near_copies


def test_links_beside_the_hubs(spark):
    """A chain: neighbours are similar, its ends are not; ids are shuffled, so that the hubs lie anywhere."""
    r = random.Random(11)
    rows, w = [], [f"w{k}" for k in range(240)]
    ids = list(range(40))
    r.shuffle(ids)
    for i in ids:
        rows.append((i, " ".join(w), "a"))
        at = r.randrange(230)
        w[at : at + 6] = [f"n{i}x{k}" for k in range(6)]
    rows += [(100 + i, " ".join([f"w{k}" for k in range(150)] + [f"{i}u{k}" for k in range(90)]), "a") for i in range(40)]  # a passage in common
    rows += [(200 + i, rows[40 + i][1].replace("u3", "v3"), "a") for i in range(0, 40, 4)]
    want = roots([x[0] for x in rows], brute_pairs([x[:2] for x in rows]))
    assert len(set(want.values())) > 10
    for bucket in (0, 2, 32):
        got = {x["doc_id"]: x["component_id"] for x in near_copies.near_copy_groups(docs_of(spark, rows), bucket).collect()}
        assert got == want


def test_open_pairs_misses_none(spark):
    """Every similar pair of two components is among them, and a passage that all share makes none by itself."""
    r = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(30):
        own = [f"{i}o{k}" for k in range(40)]
        rows.append((2 * i, " ".join(passage + own), "a"))
        own[r.randrange(40)] = "edit"
        rows.append((2 * i + 1, " ".join(passage + own), "a"))
    members = spark.createDataFrame([(i, i) for i, _, _ in rows], "id long, component long")
    texts = docs_of(spark, rows).selectExpr("doc_id AS id", "text")
    got = {tuple(x) for x in near_copies.open_pairs(members, texts).collect()}
    assert brute_pairs([x[:2] for x in rows]) <= got and len(got) <= 60
