"""The pipeline's stages against brute force, near copies at five words and similarity 0.8 as its near-copy stage is asked to take them."""

from __future__ import annotations

import math
from collections import Counter

import regex
from test_near_copies import brute_pairs, roots
from test_operators import SF, messy
from test_pipeline import poisson

import corpus_pipeline
from sparkloom.llm import mixing
from sparkloom.session import table


def test_stages_at_five_words(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, kept = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given[-1], SF).write.parquet(str(tmp_path / name))
        given.append(spark.read.parquet(str(tmp_path / name)))
        kept.append({r["doc_id"]: r["text"] for r in given[-1].collect()})
    want = roots(kept[0], brute_pairs(sorted(kept[0].items())))
    assert set(kept[1]) == {i for i in want if want[i] == i}

    words = lambda t: regex.findall(r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*", t.lower())
    grams = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    items = set().union(*(grams(r["text"]) for r in table(spark, SF, "benchmark").collect()))
    leaks = {i for i, t in kept[1].items() if grams(t) & items}
    assert leaks and not leaks & set(kept[2]) and len(set(kept[1]) - leaks - set(kept[2])) <= 2

    token = regex.compile(r'token = "[0-9a-f]{40}"')
    assert set(kept[3]) == set(kept[2]) and all(("[SECRET]" in kept[3][i]) >= bool(token.search(t)) for i, t in kept[2].items())
    source = {r["doc_id"]: r["source"] for r in given[4].collect()}
    sizes = Counter(source.values())
    draws = {r["doc_id"]: r["u"] for r in given[4].select("doc_id", mixing.uniform("mix", mixing.identity(given[4])).alias("u")).collect()}
    copies = Counter({i: poisson(draws[i], len(source) / len(sizes) / sizes[s]) for i, s in source.items()})
    assert Counter(r["doc_id"] for r in given[5].collect()) == +copies and math.isclose(sum(copies.values()), len(source), rel_tol=0.2)


def test_messy_columns_stay(spark):
    """Null, empty and very long texts, repeated rows and clashing columns pass all stages; all but the last keep every column."""
    d = messy(spark)
    columns = d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or d.columns == columns
    assert {r["doc_id"] for r in d.collect()} <= {1, 2, 4, 6, None}
