"""Copies of pictures against all pairs of descriptors, and recall by kind of edit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import media


def pictures(n):
    return [media.draw(bytes([k, 7, 9])) for k in range(n)]


def half(g):
    return (g[::2, ::2] + g[1::2, ::2] + g[::2, 1::2] + g[1::2, 1::2]) / 4


def caption(g):
    g = g.copy()
    g[-12:] = 235
    return g


EDITS = {
    "half size": half, "double size": lambda g: np.kron(g, np.ones((2, 2))), "quarter turn": np.rot90, "half turn": lambda g: np.rot90(g, 2), "crop": lambda g: g[6:72, 3:69], "brighter": lambda g: g * 0.85 + 20,
    "caption": caption, "noise": lambda g: g + np.random.default_rng(1).normal(0, 6, g.shape), "turned crop": lambda g: np.rot90(g[4:74, 8:78]), "small and brighter": lambda g: half(g) * 0.9 + 10,
}


def links(spark, images):
    """Pairs of places in the list that are linked."""
    rows = [(k, media.encode(g)) for k, g in enumerate(images)]
    d = spark.createDataFrame(rows, "node long, image binary")
    return {(r["a"], r["b"]) for r in media.consensus(media.matches(media.descriptors(d))).collect()}


@pytest.mark.parametrize("edit", EDITS)
def test_recall(edit):
    """Matches and consensus of pictures with their edited copies, without Spark."""
    found = [linked(described(g), described(EDITS[edit](g))) for g in pictures(30)]
    assert np.mean(found) >= 0.9


def described(g):
    g = media.decode(media.encode(g))
    return [(p, d) for _, pos, bits in media.corners(g[None], media.pattern()) for p, d in zip(pos.tolist(), bits.view(np.uint64).tolist())]


def linked(x, y):
    hits = [(p, q) for p, (a, b) in x for q, (c, d) in y if (a == c and (b ^ d).bit_count() <= media.NEAR) or (b == d and (a ^ c).bit_count() <= media.NEAR)]
    return len(hits) >= media.VOTES and media.agree(*np.array(hits).T)


def test_all_pairs(spark):
    images = pictures(30)
    images += [list(EDITS.values())[k % len(EDITS)](g) for k, g in enumerate(images)]
    all_of = [described(g) for g in images]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if linked(all_of[a], all_of[b])}
    assert links(spark, images) == want and len(want) >= 27 and all(b - a == 30 for a, b in want)


def test_shared_mark(spark):
    """A mark that all pictures carry makes no square of pairs: a key matches each with two others at most."""
    g = pictures(1)[0]
    images = [(k, media.encode(np.pad(g, ((0, k % 3), (0, k // 3))))) for k in range(40)]
    found = media.descriptors(spark.createDataFrame(images, "node long, image binary"))
    m = media.matches(found, hot=4).select("a", "b").distinct()
    assert m.count() <= 10 * 40 < 40 * 39 / 2
    assert media.consensus(media.matches(found, hot=4)).select(F.explode(F.array("a", "b")).alias("x")).distinct().count() == 40


def test_shared_mark_loses_no_link(spark):
    """Seventy copies of one picture, each on a ground of its own size: every two of them are linked, and each counts all others."""
    g = pictures(1)[0]
    images = [(k, media.encode(np.pad(g, ((0, k % 7), (0, k // 7))))) for k in range(70)]
    got = media.image_copies(spark.createDataFrame(images, "image_id long, image binary")).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 69)} and len(got) == 70


def test_rows_without_id(spark):
    g = media.encode(pictures(1)[0])
    d = spark.createDataFrame([(1, g), (None, g), (None, None), (1, g), (2, None)], "image_id long, image binary").withColumn("class_id", F.lit(9)).withColumn("node", F.lit("x"))
    got = sorted(((r["image_id"] or 0, r["class_id"], r["n_links"]) for r in media.image_copies(d).collect()), key=str)
    assert got == sorted([(1, 1, 0), (0, 1, 0), (0, None, 0), (1, 1, 0), (2, 2, 0)], key=str)


def test_one_common_corner(spark):
    """Three hundred pictures of which each two share one corner, or two corners in a few, make no pairs: before 44,850 matches or more."""
    rows = [(k, 5, 1, 2) for k in range(300)] + [(k, 9, 100 + k, 200 + k) for k in range(300)] + [(k, 7, 3, 4) for k in range(20)]
    m = media.matches(spark.createDataFrame(rows, media.DESCRIPTOR))
    assert m.select("a", "b").distinct().count() <= 20 * 19 / 2


@pytest.mark.parametrize(("few", "wide"), [(16, 128), (2, 128), (2, 6), (0, 0), (0, 1000)])
def test_candidates_lose_nothing(spark, monkeypatch, few, wide):
    """All matches of each two images that match at VOTES corners or more, against brute force; keys that repeat in an image, halves that are near."""
    monkeypatch.setattr(media, "FEW", few)
    monkeypatch.setattr(media, "WIDE", wide)
    rng = np.random.default_rng(few + wide)
    half = lambda: int(rng.integers(0, 9)) * 0x0101010101010101
    rows = {(n, int(p), half(), half()) for n in range(30) for p in rng.integers(0, 50, rng.integers(2, 14))}
    rows |= {(n, p, 99, 99) for n in (40, 41) for p in range(4 if n == 40 else 1)} | {(n, p, 77, 77) for n in (50, 51) for p in range(1 if n == 50 else 4)}
    want: dict = {}
    for a, p, c, d in rows:
        for b, q, e, f in rows:
            if a < b and ((c == e and (d ^ f).bit_count() <= media.NEAR) or (d == f and (c ^ e).bit_count() <= media.NEAR)):
                want.setdefault((a, b), set()).add((p, q))
    got: dict = {}
    for r in media.matches(spark.createDataFrame(sorted(rows), media.DESCRIPTOR)).collect():
        got.setdefault((r["a"], r["b"]), set()).add((r["ap"], r["bp"]))
    linked = {k: v for k, v in want.items() if len({p for p, _ in v}) >= media.VOTES}
    assert 5 <= len(linked) < len(want) and (40, 41) in linked and {k: got.get(k) for k in linked} == linked and all(want[k] == v for k, v in got.items())
