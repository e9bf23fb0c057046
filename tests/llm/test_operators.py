"""Operators of the training-data pipeline against brute-force versions on small fixtures, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, licenses, media, mixing, quality, secret_scans, simhash, substrings, toxicity, warc
from sparkloom.llm import queries as Q

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


def messy(spark):
    """Nulls in any column, an empty text, a very long one, repeated rows, ties, and columns whose names clash."""
    words = [f"w{k % 997}" for k in range(40_000)]
    d = docs_of(
        spark,
        [
            (1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", None), (4, " ".join(words), "b"), (None, "some words here idiot", "b"),
            (5, "   \n\t ", "b"), (6, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', None), (7, "ONE two three", "a"), (None, None, None),
        ],
    )
    for c in ("score", "Copy", "redacted", "license_id", "key", "fp", "id", "data", "n_secrets", "canonical_digest", "component_id"):
        d = d.withColumn(c, F.lit(7))
    return d


def empty(spark):
    return docs_of(spark, []).limit(0)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages", "embeddings")}


# 8: SimHash


def brute_simhash(rows):
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, f"{fps[i]:016x}", root(i)) for i in ids}


def near_copies(n=60, seed=5):
    r = random.Random(seed)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(40)}" for _ in range(150)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(i % 3):
            w[r.randrange(len(w))] = "edit"
        rows.append((i * 3, " ".join(w)))
    return [*rows, (1001, None), (1002, ""), (1003, "two words"), (1004, "Two WORDS")]


def test_simhash(spark):
    rows = near_copies()
    got = simhash.op8_simhash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_simhash(rows)


@pytest.mark.parametrize("bucket", [0, 1, 3])
def test_simhash_large_buckets(spark, bucket):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 80:
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    links = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), bucket)
    edges = [(x["a"], x["b"]) for x in links.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in edges)
    parent = list(range(len(fps)))

    def root(x, p):
        while p[x] != x:
            x = p[x]
        return x

    want = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a, want), root(b, want)))
                want[y] = x
    for a, b in edges:
        x, y = sorted((root(a, parent), root(b, parent)))
        parent[y] = x
    assert [root(i, parent) for i in range(len(fps))] == [root(i, want) for i in range(len(fps))]


def test_near_duplicates_dropped(spark):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in simhash.drop_near_duplicates(messy(spark)).collect())
    assert [x for _, x in got if _] == [1, 2, 4, 6] and len([x for x in got if not x[0]]) == 2


# 5: substrings


def brute_repeats(rows, w=20):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            first = seen.setdefault(tuple(words[k : k + w]), (i, t, k))
            if first != (i, t, k):
                gone[k : k + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(2)
    line = [f"l{k}" for k in range(30)]
    rows = []
    for i in range(60):
        w = [f"v{r.randrange(300)}" for _ in range(r.randrange(5, 90))]
        if i % 2:
            at = r.randrange(len(w))
            w[at:at] = line[r.randrange(6) : 30 - r.randrange(4)]
        if i % 7 == 0:
            w += ["same"] * r.randrange(15, 50)
        if i % 11 == 0 and rows:
            w = rows[r.randrange(len(rows))][1].split() + w[:3]
        rows.append((i, "  ".join(w)))
    rows += [(100, None), (101, ""), (102, " ".join(line[:20])), (103, " ".join(line[:19]))]
    got = substrings.op5_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_repeats(rows)


def test_substrings_messy(spark):
    rows = [(r["doc_id"], r["text"]) for r in messy(spark).collect()]
    got = sorted((tuple(x) for x in substrings.op5_substring_dedup(messy(spark)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_matching_statistics():
    r = random.Random(3)
    text, other = [r.randrange(3) for _ in range(120)], [r.randrange(3) for _ in range(60)]
    a = substrings.Automaton()
    a.add(text[:60]), a.add(text[60:])
    both = [text[:60], text[60:]]
    inside = lambda x: any(x == t[i : i + len(x)] for t in both for i in range(len(t) - len(x) + 1))
    want = [max(n for n in range(i + 2) if inside(other[i + 1 - n : i + 1])) for i in range(len(other))]
    assert a.statistics(other) == want


def test_bounded_reference(spark):
    ref = [f"r{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(["x", *ref[10:40], "y", *ref[50:60]])), (2, None), (3, "")], "doc_id long, text string")
    got = substrings.match_reference(docs, spark.createDataFrame([(" ".join(ref),), (None,)], "text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, 30)]
    with pytest.raises(ValueError):
        substrings.match_reference(docs, spark.createDataFrame([("long",)], "text string"), limit=2)


# 7: WARC


def test_warc(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nü"
    rows = [(1, "http://b.example/x", "same"), (2, "HTTP://A.example/ y?q=1", "same"), (3, None, None), (4, "", ""), (5, "http://a.example/y", tricky), (6, "http://[bad", tricky), (7, "u", "q" * 300_000), (7, "u", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.op7_warc(pages).collect()), key=str)
    least, want = {}, []
    for i, _, h in rows:
        least[h or ""] = min(i, least.get(h or "", i))
    for i, _, h in rows:
        b = (h or "").encode()
        digest = __import__("base64").b32encode(hashlib.sha1(b).digest()).decode()
        first = least[h or ""]
        want.append((i, len(b), digest, "revisit" if first < i else "response", first if first < i else None))
    assert got == sorted(want, key=str)
    assert warc.op7_warc(pages.limit(0)).count() == 0


def test_index_order(spark, tables):
    from sparkloom.session import cut, scratch

    index = cut(warc.read_warc(spark, warc.write_warc(tables["pages"], scratch(spark, "t"))))
    merged = [warc.order(tuple(r)) for r in warc.merge_index(index).orderBy("position").collect()]
    assert merged == sorted(merged) and len(merged) == tables["pages"].count()


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted((f"u{r.randrange(9)}", f"d{r.randrange(3)}", r.randrange(99)) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.loser_tree([iter(x) for x in runs])) == sorted(x for y in runs for x in y)


# 6: licences


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    changed = "The MIT License (MIT)\n\nCopyright (c) 2021 Someone\n\n" + mit.upper().replace(". ", ".  \n").replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, changed, "a"), (2, mit + " and more", "a"), (3, licenses.TEXTS["ISC"], "a"), (4, None, "a"), (5, "", "a"), (6, "!!!", "a")]
    got = {r["doc_id"]: (r["license_id"], r["canonical_digest"]) for r in licenses.op6_licenses(docs_of(spark, rows)).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["MIT", None, "ISC", None, None, None] and got[4][1] is None and got[5][1] == got[6][1]
    out = licenses.scan_licenses(messy(spark), licenses.known_licenses(spark, {"x": "One, two; THREE"}))
    assert out.where("license_id = 'x'").count() == 3 and out.count() == 10 and len(out.columns) == len({c.lower() for c in out.columns})
    assert licenses.op6_licenses(empty(spark)).count() == 0


# 9: mixing


def test_mixing(spark):
    rows = [(i, f"t{i}", ["a", "b", None][(i > 20) + (i > 25)]) for i in range(30)] + [(None, "x", "a"), (3, "t3", "a")]
    d = docs_of(spark, rows).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE.format(docs="documents")).fetchall()
    got = [(r["doc_id"], r["text"], r["source"], r["n_copies"], r["copy"], r["shuffle_key"]) for r in mixing.mix(d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(many, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 200 and abs(n["b"] - 1000) < 130
    assert mixing.mix(many, {"a": 1}).where("source = 'b'").count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(messy(spark)).columns[-3:] == ["n_copies", "copy", "shuffle_key"]


def test_mixing_many_sources(spark, monkeypatch):
    d = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    want = sorted(map(str, mixing.mix(d).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(str, mixing.mix(d).select(*mixing.mix(d).columns).collect())) == want


# 2: secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scans.train(secret_scans.made_findings(spark))


def test_forest_on_unseen_findings(spark, forest):
    unseen = secret_scans.made_findings(spark, 9_000).exceptAll(secret_scans.made_findings(spark, 6_000))
    f = secret_scans.feature_columns(*(F.col(c) for c in ("candidate", "left", "right", "path")))
    y = unseen.select(F.col("is_secret").alias("y"), (secret_scans.forest_score(forest, {k: v.cast("double") for k, v in f.items()}) >= 0.5).cast("double").alias("p"))
    assert y.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0] > 0.97


def test_expression_is_the_forest(spark, forest):
    from pyspark.ml.feature import VectorAssembler

    f = secret_scans.feature_columns(*(F.col(c) for c in ("candidate", "left", "right", "path")))
    x = secret_scans.made_findings(spark, 400).select(*[v.cast("double").alias(k) for k, v in f.items()])
    both = forest.transform(VectorAssembler(inputCols=list(secret_scans.FEATURES), outputCol="features").transform(x)).withColumn("mine", secret_scans.forest_score(forest, {k: F.col(k) for k in secret_scans.FEATURES}))
    assert all(abs(r["probability"][1] - r["mine"]) < 1e-9 for r in both.collect())


def test_secrets(spark, forest):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'the token = "{key}" of\n{key} ü', "a"), (2, f"see commit {key} for this", "a"), (3, "nothing", "a"), (4, f'api_key = "{key}"', "a")]
    got = {r["doc_id"]: r for r in secret_scans.scan_secrets(docs_of(spark, rows), forest).collect()}
    assert got[1]["n_candidates"] == 2 and got[1]["n_secrets"] >= 1 and got[1]["redacted"].startswith('the token = "[SECRET]" of\n')
    assert got[2]["n_secrets"] == 0 and got[2]["redacted"] == rows[1][1] and got[3]["n_candidates"] == 0 and got[4]["redacted"] == 'api_key = "[SECRET]"'
    m = secret_scans.scan_secrets(messy(spark), forest)
    assert m.count() == 10 and m.where("n_secrets = 1").count() == 1 and secret_scans.scan_secrets(empty(spark), forest).count() == 0
    assert secret_scans.redact(messy(spark), forest).columns == messy(spark).columns


# 4: decontamination

ITEM = "A train that left Boston at 9 travels 120 miles in 2 hours while a slower train from Denver needs 5 hours for it."


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "exactly seven words stand in this")], "item_id long, text string")
    other = ITEM.replace("Boston", "Madrid").replace("Denver", "Lisbon").replace("9", "7").replace("120", "310").replace("2 hours", "4 hours").replace("5 hours", "6 hours")
    uneven = ITEM.replace("120", "9").replace("5 hours", "9 hours")
    rows = [(1, "some text before. " + ITEM + " And after", "a"), (2, other, "a"), (3, uneven, "a"), (4, "A train that left late", "a"), (5, None, "a"), (6, "", "a"), (7, "so exactly seven words stand in this way", "a"), (8, ITEM.upper(), "a")]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.op4_decontamination(docs_of(spark, rows), bench).collect()}
    assert got[1, 1] is True and got[2, 1] is False and (3, 1) not in got and got[7, 5] is True and not [k for k in got if k[0] in (4, 5, 6)]
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs_of(spark, rows), bench).collect()}
    assert {3, 4, 5, 6} <= kept and not kept & {1, 2, 7}
    assert decontaminate.drop_contaminated(messy(spark), bench).count() == 10
    assert decontaminate.op4_decontamination(empty(spark), bench).count() == 0 and decontaminate.op4_decontamination(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_brute_force(tables, spark):
    import regex

    def words(t):
        return regex.findall(r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*", t.lower())

    index = {}
    for r in tables["benchmark"].collect():
        w = words(r["text"])
        for k in range(len(w) - 12):
            index.setdefault(tuple(w[k : k + 13]), set()).add(r["item_id"])
    want = set()
    for r in tables["documents"].collect():
        w = words(r["text"] or "")
        for k in range(len(w) - 12):
            want |= {(r["doc_id"], i) for i in index.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontamination(tables["documents"], tables["benchmark"]).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want)


# 3: toxicity


def test_toxicity_folding():
    lex = toxicity.Lexicon()
    a = lex.automaton()
    bad = ["you idiot", "an 1d10t speaks", "ѕtuріd man", "what $cum", "SТUРID!", "id​iot", "ｉｄｉｏｔ", "ídíot"]
    good = ["a fine day", "put it in the trash can", "idiotype studies", "12 345 678", "", None]
    assert all(lex.raw(t, a) > 0 for t in bad) and all(lex.raw(t, a) == 0 for t in good)
    assert lex.raw("idiot", a) > lex.raw("idiot " + "word " * 300, a) > 0


def test_toxicity_held_out(spark, tables):
    rows = toxicity.op3_toxicity(tables["documents"], tables["labels"]).collect()
    y = {r["doc_id"]: r["toxic"] for r in tables["labels"].collect()}
    assert len(rows) == 1000 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    held = [(r["predicted"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert sum(p == t for p, t in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_edges(spark, tables):
    none = tables["labels"].limit(0)
    got = toxicity.op3_toxicity(messy(spark), none).collect()
    assert len(got) == 10 and sum(r["predicted"] for r in got) == 1
    assert toxicity.op3_toxicity(empty(spark), none).count() == 0
    kept = toxicity.drop_toxic(messy(spark), toxicity.Lexicon())
    assert kept.count() == 9 and kept.columns == messy(spark).columns


# 1: quality


def test_quality_held_out(spark, tables):
    rows = quality.op1_quality(tables["documents"], tables["labels"]).collect()
    y = {r["doc_id"]: r["quality"] for r in tables["labels"].collect()}
    held = [(r["score"], r["predicted"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    good, poor = [s for s, _, t in held if t], [s for s, _, t in held if not t]
    assert np.mean([a > b for a in good for b in poor]) > 0.97 and np.mean([p == t for _, p, t in held]) > 0.93


def test_quality_edges(spark, tables):
    none = tables["labels"].limit(0)
    assert {r["score"] for r in quality.op1_quality(messy(spark), none).collect()} <= {0.4995, 0.5}
    assert quality.op1_quality(empty(spark), none).count() == 0
    ones = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.op1_quality(messy(spark), ones).collect())


# 10: media


def test_media(spark, tables):
    e = tables["embeddings"].limit(40).unionByName(spark.createDataFrame([(9001, None, None)], tables["embeddings"].schema))
    e = e.unionByName(tables["embeddings"].limit(1).withColumn("vec_id", F.lit(9002).cast("long")))
    first = tables["embeddings"].limit(1).first()["vec_id"]
    got = {r["image_id"]: (r["class_id"], r["n_links"]) for r in media.op10_media(e).collect()}
    assert len(got) == 84 and got[18004][0] == got[2 * first][0] and got[18002] == (18002, 0)
    pairs = [i for i in got if i % 2 == 0 and i not in (18002, 18004)]
    assert np.mean([got[i][0] == got[i + 1][0] for i in pairs]) >= 0.9
    assert all(got[i][0] // 2 == i // 2 for i in got if i < 18000 and i // 2 != first)
    odd = spark.createDataFrame([(1, b"no image"), (2, b"P5 2 2 255\n1234"), (3, None), (4, b"no image")], "image_id long, image binary")
    assert {r["image_id"]: r["class_id"] for r in media.image_copies(odd).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert media.image_copies(odd.limit(0)).count() == 0


def test_every_number_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
