"""Pieces of one key with other words are never taken as equal by a cut hash."""

from __future__ import annotations

import numpy as np
from test_operators import brute_repeats, empty

from sparkloom.llm import substrings


def test_pieces_keep_64_bits():
    p = np.zeros(2, substrings.PIECE)
    p["key"], p["doc"], p["seq"] = 7, [1, 2], [5, 5 + (1 << 32)]
    assert substrings.firsts(p)[1].all()
    words = substrings.tokens(" ".join(f"w{k}" for k in range(20)))
    whole = substrings.spans_hash(substrings.prefix_sums(words), np.zeros(1, np.int64), 20)
    assert substrings.pieces(1, words)["seq"].tolist() == whole.tolist() and whole[0] >> np.uint64(32)


def test_pieces_need_128_equal_bits():
    p = np.zeros(3, substrings.PIECE)
    p["key"], p["doc"], p["seq"], p["alt"] = 7, [1, 2, 3], 5, [1, 2, 2]
    assert substrings.firsts(p)[1].tolist() == [True, True, False]


def test_common_gram_removes_nothing_unique(spark):
    """Many documents share one run of eight words; no window of 20 repeats."""
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(6)), *(f"c{k}" for k in range(8)), *(f"b{i}x{k}" for k in range(6))])) for i in range(3000)]
    got = substrings.op5_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and all(r["n_words"] == 20 and r["n_removed"] == 0 for r in got)


def test_keys_dealt_by_piece(spark, monkeypatch):
    """With every key treated as too large for one task the result is the same."""
    monkeypatch.setattr(substrings, "GATHER", 1)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000)
    rows = [(i, " ".join([f"v{i * j % 37}" for j in range(25)] + [f"l{k}" for k in range(24)] + [f"u{i % 5}"])) for i in range(80)]
    got = substrings.op5_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_repeats(rows)


def test_empty(spark):
    assert substrings.op5_substring_dedup(empty(spark)).count() == 0
