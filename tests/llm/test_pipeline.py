"""The corpus pipeline, stage by stage, against brute force over what each stage was given."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import regex
from test_operators import SF, brute_simhash, empty, messy

import corpus_pipeline
from sparkloom.llm import toxicity
from sparkloom.session import table


def poisson(u, rate):
    k, logp = 0, -rate
    total = math.exp(logp)
    while total <= u:
        k += 1
        logp += math.log(rate / k)
        total += math.exp(logp)
    return k


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given, kept = docs.columns, [docs], []
    lex = toxicity.learn(docs, table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given[-1], SF).write.parquet(str(tmp_path / name))
        given.append(spark.read.parquet(str(tmp_path / name)))
        kept.append({r["doc_id"]: r["text"] for r in given[-1].collect()})
    assert all(d.columns == columns for d in given[:-1])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    a = lex.automaton()
    assert set(kept[0]) == {i for i, t in before.items() if lex.score(t, a) < 0.3}
    assert set(kept[1]) == {i for i, _, root in brute_simhash(kept[0].items()) if i == root}

    words = lambda t: regex.findall(r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*", t.lower())
    grams = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    items = set().union(*(grams(r["text"]) for r in table(spark, SF, "benchmark").collect()))
    leaks = {i for i, t in kept[1].items() if grams(t) & items}
    assert leaks and not leaks & set(kept[2]) and len(set(kept[1]) - leaks - set(kept[2])) <= 2

    assert set(kept[3]) == set(kept[2])
    token = regex.compile(r'token = "[0-9a-f]{40}"')
    assert all(("[SECRET]" in kept[3][i]) >= bool(token.search(t)) for i, t in kept[2].items())
    assert all(kept[3][i] == t for i, t in kept[2].items() if "[SECRET]" not in kept[3][i])

    source = {r["doc_id"]: r["source"] for r in given[4].collect()}
    sizes = Counter(source.values())
    u = lambda i: int(hashlib.md5(f"mix_{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = Counter({i: poisson(u(i), len(source) / len(sizes) / sizes[s]) for i, s in source.items()})
    assert Counter(r["doc_id"] for r in given[5].collect()) == +want


def test_messy_and_empty(spark):
    for d in (messy(spark).select("doc_id", "text", "lang", "source", "n_chars"), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        d.count()
