"""Known answers for operators and quirks that SQL twins do not reach."""

from __future__ import annotations

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.operators import analytics as A
from sparkloom.operators import cluster as C
from sparkloom.operators import etl as E
from sparkloom.operators import fuzzy as Z
from sparkloom.operators import graph, identity, labeling, logs, metrics, neardup, retrieval, sampling, semantic
from sparkloom.plans import tabular
from sparkloom.sources import generators as X
from sparkloom.sources import io as IO


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_edit_distances(spark):
    assert Z.osa("galaxy", "galxay") == 1 and Z.osa("ca", "abc") == 3 and Z.osa("astronomy", "astronomer") == 2 and Z.osa("", "ab") == 2
    assert one(spark, T.prefix_similarity(*lit("Jonathan", "Johnathan"))) == pytest.approx(0.911111, abs=1e-6)
    assert one(spark, T.prefix_similarity(*lit("Jonathan", "Jonathon"))) == pytest.approx(0.925, abs=1e-6)
    assert one(spark, T.prefix_similarity(*lit("a", "a"))) == 1.0
    assert one(spark, T.stem(F.lit("Astronomy"))) == one(spark, T.stem(F.lit("astronomer"))) == "astronom"
    assert one(spark, T.hex_mod(F.md5(F.lit("0_page_42")), 500)) == int(__import__("hashlib").md5(b"0_page_42").hexdigest(), 16) % 500


def test_vocabulary_lookup(spark):
    words = ["planet", "plane", "plant", "galaxy", "star", "comet", "moon"]
    voc = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, freq long")
    q = spark.createDataFrame([("planett",)], "query string")
    assert [r["word"] for r in Z.deletion_lookup(q, voc).collect()] == ["planet"]
    got = {(r["word"], r["distance"]) for r in Z.radius_search(q, voc, 2).collect()}
    assert got == {(w, Z.osa("planett", w)) for w in words if Z.osa("planett", w) <= 2}


def test_radius_reaches_short_words(spark):
    words = ["a", "b", "ab", "ba", "cd", "abc", "xyz"]
    voc, q = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in words], "query string")
    got = {(r["query"], r["word"]) for r in Z.radius_search(q, voc, 2).collect()}
    assert got == {(a, b) for a in words for b in words if Z.osa(a, b) <= 2}


def test_identity(spark):
    rows = spark.createDataFrame([(i, f"https://example.com/page_{i}") for i in range(50)], "id int, x string")
    bits = identity.bloom_bits(rows, "x")
    assert bits.count() == 133
    asked = spark.createDataFrame([(f"https://example.com/page_{i}",) for i in (42, 99, 7)], "x string")
    assert {r["x"]: r["maybe"] for r in identity.bloom_contains(asked, bits, "x").collect()} == {f"https://example.com/page_{i}": i < 50 for i in (42, 99, 7)}
    assert one(spark, T.clean(F.lit("  The   Quick, Brown! "))) == "the quick brown"
    assert one(spark, T.weak_hash(F.lit("ab"))) == one(spark, T.weak_hash(F.lit("ba"))) == 195


def test_retrieval(spark):
    docs = [
        ("A", "new york is a very big city"), ("B", "york is old but new things are in new places"[:46]), ("C", "battery " * 50), ("D", "the battery is very good"), ("E", "battery " * 20 + "x " * 420), ("F", "buy cheap running trainers for your sport today"),
    ]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    dl = {r["doc_id"]: r["dl"] for r in retrieval.lengths(df, "doc_id", "text").collect()}
    n, avg = len(dl), sum(dl.values()) / len(dl)
    terms = retrieval.query_terms(spark.createDataFrame([(1, "battery")], "query_id int, query string"))
    got = {r["doc_id"]: r["score"] for r in retrieval.search(df, "doc_id", "text", terms).collect()}
    idf = math.log(1 + (n - 3 + 0.5) / 3.5)
    tf = {"C": 50, "D": 1, "E": 20}
    assert got == {d: pytest.approx(idf * f * 2.25 / (f + 1.25 * (0.2 + 0.8 * dl[d] / avg))) for d, f in tf.items()}
    ph = retrieval.phrase(df, "doc_id", "text", spark.createDataFrame([(1, "New York"), (2, "")], "query_id int, query string"))
    assert [(r["query_id"], r["doc_id"]) for r in ph.collect()] == [(1, "A")]
    syn = spark.createDataFrame([("sneakers", "trainers")], "term string, synonym string")
    t1 = retrieval.query_terms(spark.createDataFrame([(1, "sneakers")], "query_id int, query string"))
    assert retrieval.search(df, "doc_id", "text", t1).count() == 0
    assert [r["doc_id"] for r in retrieval.search(df, "doc_id", "text", retrieval.expand(t1, syn)).collect()] == ["F"]
    assert one(spark, retrieval.idf(F.lit(5), F.lit(0))) == 0.0


def test_chunks_and_vectors(spark):
    assert one(spark, T.chunks(F.lit("one  two three"))) == ["one  two three"]
    assert one(spark, T.chunks(F.lit("a b c d e f g h i j"))) == ["a b c d e f", "e f g h i j"]
    assert one(spark, V.cosine(F.array(*lit(0.0, 0.0)), F.array(*lit(1.0, 0.0)))) == 0.0
    assert one(spark, V.cosine(F.array(*lit(1.0, 1.0)), F.array(*lit(1.0, 0.0)))) == pytest.approx(0.70710678)
    assert one(spark, semantic.lexical_overlap(*lit("a b c", "b c d b"))) == 2
    assert one(spark, T.shingles(F.lit("Too short."))) == []
    assert one(spark, T.shingles(F.lit("a b. c, d"))) == ["a b c", "b c d"]


def test_signatures(spark):
    df = spark.createDataFrame([(1, ""), (2, "x y"), (3, "a b c d"), (4, "a b c d"), (5, "a b c d e")], "id int, text string")
    sig = {r["id"]: r["signature"] for r in neardup.minhash(df, "id", "text").collect()}
    assert sig[1] == sig[2] == ["inf"] * 100 and sig[3] == sig[4] and len(sig[5]) == 100
    import hashlib

    assert sig[3][7] == min(hashlib.sha1(f"7_{s}".encode()).hexdigest() for s in ("a b c", "b c d"))
    pairs = {(r["a"], r["b"]) for r in neardup.candidates(neardup.bands(neardup.minhash_fast(df, "id", "text"), "id"), "id").collect()}
    assert {(1, 2), (3, 4)} <= pairs and all(a < b for a, b in pairs)


def test_similar_sets_are_exact(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i] + [f"z{i}_{k}" for k in range(i)])) for i in range(12)] + [(20, " ".join(base)), (21, "short"), (22, None), (23, "")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and a != 20 and b != 20 and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    df = spark.createDataFrame(rows, "id int, text string")
    assert {(r["a"], r["b"]) for r in neardup.similar_sets(df, "id", "text").collect()} == want


def test_labeling(spark):
    rows = [(1, "please cancel it!"), (2, "why was I billed? refund"), (3, "ok."), (4, "hello world"), (5, None)]
    d = labeling.route(labeling.votes(spark.createDataFrame(rows, "id int, text string"), "text"))
    got = {r["id"]: (r["route"], r["final_label"]) for r in d.collect()}
    assert got[1] == ("auto_labeled", "CANCEL_INTENT") and got[2][0] == "human_review" and got[3] == ("unknown_unknowns", None)
    assert got[4] == ("auto_labeled", "BILLING_ISSUE") and got[5][0] == "unknown_unknowns"
    registry = [labeling.any_of("A", "x"), labeling.any_of("B", "x"), labeling.any_of("B", "y"), labeling.any_of("B", "z")]
    r = labeling.route(labeling.votes(spark.createDataFrame([("xyz",)], "text string"), "text", registry)).first()
    assert (r["top_label"], r["consensus"], r["route"]) == ("B", 0.75, "auto_labeled")


def test_whole_words_are_ascii(spark):
    """A letter beyond ASCII ends a word, as in the SQL of lf_votes; an ASCII letter, digit or underscore does not."""
    rows = [(0, "éles x"), (1, "lesé"), (2, "tables"), (3, "les_"), (4, "9des"), (5, "POUR"), (6, "a-les.")]
    got = labeling.votes(spark.createDataFrame(rows, "id int, text string"), "text", tabular.WORDS)
    assert {r["id"] for r in got.collect() if "FRENCH" in r["votes"]} == {0, 1, 5, 6}


def test_planted_actors(spark):
    lines = X.attack_log(spark, 2_000)
    odd = spark.createDataFrame([("{broken FAILURE",), ('{"timestamp": 5, "status": "FAILURE"}',), ('["FAILURE"]',), ('{"ip_address": "1.1.1.1", "timestamp": 5, "status": "SUCCESS", "meta": "FAILURE"}',)], "value string")
    got = logs.banned(logs.failures(lines.unionByName(odd)), "ip_address", F.floor(F.col("timestamp") / 86400), 50)
    assert sorted(r["ip_address"] for r in got.collect()) == ["10.0.0.99", "192.168.1.66"]


def test_seconds_are_rounded(spark):
    """An event half a second before midnight, or later, is of the next day, as in the SQL of ban_addresses."""
    at = ["2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-01-01 23:59:59.9", "2024-01-02 00:00:00.4", "2024-01-01 23:59:58.5"]
    rows = spark.createDataFrame([(k + 1, 7, x) for k, x in enumerate(at)], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp_ntz("ts")).withColumn("event_type", F.lit("error"))
    found = logs.failures(X.security_log(rows)).select("timestamp").collect()
    start = 1_704_067_200
    assert sorted(r["timestamp"] - start for r in found) == [86_398, 86_399, 86_400, 86_400, 86_400]


def test_log_lines(spark):
    rows = ["2024-01-01 10:00:00 [ERROR] service=a took 12ms and 30ms", "2024-01-01 x", "2024-01-02 10:00:00 [INFO] no name 5ms", "2024-01-02  10:00:00\t[WARN] service=b, 4821msx", ""]
    got = [tuple(r) for r in logs.parse(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    assert got == [("2024-01-01", "ERROR", "a", 12), ("2024-01-02", "WARN", "b,", None)]


def test_documents_of_json(spark, tmp_path):
    item = {"metadata": {"internal_id": " ID_1​", "source_node": "x"}, "payload": {"product_name": "n", "dept": "Books", "metrics": {"rating": None, "weight_oz": 3}, "history": {"created_at": "1672531200"}, "price": "$1,234.50"}}
    other = {"metadata": {"internal_id": "ID_2"}, "payload": {"dept": "Books", "history": {"created_at": "03/04/2023"}, "pricing_info": {"msrp_usd": 9.5, "currency": "USD"}}}
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "data_lake_exports": {"inventory_items": [item, other]}}, indent=2))
    got = {r["id"]: (r["price"], str(r["launch_date"])) for r in E.tidy(E.clean_inventory(E.flatten(IO.read_document(spark, str(tmp_path / "a.json"))))).collect()}
    assert got == {"ID_1": (1234.5, "2023-01-01 00:00:00"), "ID_2": (9.5, "2023-03-04 00:00:00")}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "doc_A.txt").write_text("one\ntwo")
    assert [tuple(r) for r in IO.read_texts(spark, str(tmp_path / "docs")).collect()] == [("doc_A", "one\ntwo")]
    IO.write_sorted_text(spark.createDataFrame([("b",), ("a",)], "v string"), "v", str(tmp_path / "out"))
    assert [r["value"] for r in IO.read_lines(spark, str(tmp_path / "out")).collect()] == ["a", "b"]
    assert IO.shard_count(0, 5000) == 1 and IO.shard_count(1, 5000) == 2
    with pytest.raises(ValueError):
        IO.shard_count(1 << 40, 5000)


def test_departments(spark):
    rows = [("ID_100", "n", "A", 10.0, 5.0), ("b", "n", "A", 30.0, None), ("c", "n", "B", 7.0, 4.6)]
    df = A.enrich(A.with_cost(spark.createDataFrame(rows, "id string, name string, dept string, price double, rating double"), spark.createDataFrame([("b", 15.0), ("c", 9.0)], "id string, unit_cost double")))
    got = {r["id"]: r for r in df.collect()}
    assert got["ID_100"]["unit_profit"] == -5.0 and got["c"]["price_zscore"] is None and got["b"]["margin_pct"] == 50.0
    assert {r["dept"]: r["total_loss"] for r in A.dept_stats(df).collect()} == {"A": -5.0, "B": -2.0}


def test_metric_edges(spark):
    empty = spark.createDataFrame([], "y_true int, y_pred int")
    r = metrics.with_scores(metrics.confusion(empty)).first()
    assert (r["tp"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0.0, 0.0, 0.0, 0.0)
    p = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (7, 0.3)], "y_true int, y_prob double")
    s = {round(r["t"], 2): r for r in metrics.sweep(p).collect()}
    assert (s[0.5]["tp"], s[0.5]["fp"]) == (2, 1) and s[0.51]["tp"] == 1 and s[0.95]["precision"] == 1.0 and len(s) == 101
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert metrics.kappa(same, ["x", "y"], "a", "b").first()["kappa"] == 1.0
    assert metrics.kappa(same.limit(0), ["x", "y"], "a", "b").first()["kappa"] == 0.0
    lazy = metrics.with_scores(metrics.confusion(X.binary_labels(spark, 10_000, 0.5, 0.9, 0.1))).first()
    assert abs(lazy["accuracy"] - 0.9) < 0.02 and abs(lazy["recall"] - 0.9) < 0.02
    auc = metrics.curve_areas(metrics.sweep(X.scores(spark, 4_000))).first()
    assert auc["roc_auc"] > 0.85


def test_clusters(spark):
    x, y, kind = C.donut_point("id")
    pts = spark.range(650).select("id", x.alias("x"), y.alias("y"), kind.alias("kind"))
    got = C.dbscan(pts, "id", "x", "y")
    rows = {r["id"]: (r["x"], r["y"]) for r in pts.collect()}
    near = {i: [j for j in rows if math.dist(rows[i], rows[j]) <= 1.5] for i in rows}
    core = {i for i in rows if len(near[i]) >= 5}
    label: dict[int, int] = {}
    for i in sorted(core):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        todo.append(j)
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in rows}
    assert {r["id"]: r["cluster"] for r in got.collect()} == want


def test_kmeans_and_cover(spark):
    pts = [[0.0, 0.0], [10.0, 10.0], [0.0, 1.0], [10.0, 11.0], [1.0, 0.0], [50.0, 50.0]]
    df = spark.createDataFrame(list(enumerate(pts)), "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in C.kmeans(df, "id", "v", 2).collect()}
    assert got[0] == got[2] == got[4] and got[1] == got[3]
    assert [r["id"] for r in sampling.core_set(df, "id", "v", 3).orderBy("pick").collect()] == [0, 5, 3]
    assert sampling.core_set(df.limit(0), "id", "v", 3).count() == 0


def test_uncertainty_scores(spark):
    p = F.array(*lit(0.9, 0.05, 0.05))
    assert one(spark, sampling.margin(p)) == pytest.approx(0.85)
    assert one(spark, sampling.entropy(p)) == pytest.approx(0.568996, abs=1e-6)
    assert one(spark, sampling.disagreement(F.array(*lit(0.2)))) == 0.0
    assert one(spark, sampling.disagreement(F.array(*lit(0.2, 0.4)))) == pytest.approx(0.02)
    assert one(spark, sampling.uncertainty(F.lit(0.51))) == pytest.approx(0.98)


def test_bleeding_rating(spark):
    rows = [("A", "2024-01-05", 4.0), ("B", "2024-01-05", None), ("B", "2024-03-01", 2.0)]
    df = spark.createDataFrame(rows, "dept string, launch_date string, rating double").withColumn("launch_date", F.to_date("launch_date"))
    sane = [r["rating"] for r in A.monthly_rating(df).orderBy("dept", "month").collect()]
    bled = [r["rating"] for r in A.monthly_rating(df, bleed=True).orderBy("dept", "month").collect()]
    assert sane == [4.0, None, None, 2.0] and bled == [4.0, 4.0, 4.0, 2.0]


def test_safe_regex(spark):
    got = spark.createDataFrame([("word " * 10 + "word",), ("word " * 2000 + "!",), ("",), ("",)], "t string").select(E.matches_safe(F.col("t")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components(spark, edges):
    df = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in graph.connected_components(df).collect()} == want


def test_generators(spark):
    assert E.tidy(E.clean_inventory(E.flatten(X.messy_inventory(spark, 300)))).count() == 300 - 300 // 97
    d = X.uncertain_docs(spark)
    got = sampling.top(d, F.round(sampling.margin(F.col("probs")), 9), "id", 10, ascending=True).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in got} == {"NOISE": 5, "HARD": 5}
    q = sampling.top(d, sampling.disagreement(F.transform("committee_probs", lambda p: p[0])), "id", 15).select("type").distinct().collect()
    assert [r["type"] for r in q] == ["HARD"]
    b = X.boxes(spark, {"a": (20, 0.0, 0.0, 2.0), "b": (20, 8.0, 8.0, 2.0), "rare": (5, 0.0, 9.0, 1.0)})
    assert C.kmeans(b, "id", "vector", 3).count() == 45
    m = metrics.macro_micro(X.four_classes(spark), ["SAFE", "TOXIC", "SELF_HARM", "GIBBERISH"], "y_true", "lazy").first()
    assert abs(m["micro_f1"] - 0.8) < 0.02 and m["macro_f1"] < 0.25
    k = metrics.kappa(X.four_classes(spark), ["SAFE", "TOXIC", "SELF_HARM", "GIBBERISH"], "y_true", "annotator").first()
    assert k["agreement"] > 0.9 and 0.6 < k["kappa"] < 0.95
    assert X.population(spark, 1000, {"x": 0.5, "y": 0.3}).groupBy("intent").count().count() == 3
    assert logs.tokens_with(X.template_lines(spark, 50), "service:").count() == 50


def test_controlled_documents(spark):
    text = " ".join(f"word{k}{'.' if k % 12 == 11 else ''}" for k in range(72))
    docs = X.related_documents(spark, text, " ".join(f"other{k}" for k in range(60)))
    rows = neardup.shingle_rows(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    got = {(r["a"], r["b"]): (r["jaccard"], r["containment"]) for r in neardup.overlaps(rows, rows).where("a < b").collect()}
    assert got["A", "D"][1] == got["A", "C"][1] == got["D", "E"][1] == 1.0 and got["A", "B"][0] > 0.8 and ("A", "E") not in got
    sig = {r["doc_id"]: r["signature"] for r in neardup.minhash(docs, "doc_id", "text").collect()}
    est = spark.createDataFrame([(sig["A"], sig["B"])], "a array<string>, b array<string>").select(neardup.agreement(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert abs(est - got["A", "B"][0]) < 0.15


def test_numbered_places(spark):
    from sparkloom.session import numbered

    rows = [(g, v) for v, g in enumerate([None, "a", "a", "b", "a", None, "b", "a"] * 40)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    place, want = {}, set()
    for g, v in rows:
        place[g] = place.get(g, 0) + 1
        want.add((g, v, place[g]))
    assert {tuple(r) for r in numbered(df, ["g"], ["v"], "n").collect()} == want
    assert numbered(df.limit(0), ["g"], ["v"], "n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), max_size=12))
def test_osa_blocks(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert Z.osa_block(a, b, 40).tolist() == Z.osa_block(a, b).tolist() == [Z.osa(x, y) for x, y in pairs]


def test_quantiles_and_draws(spark):
    import numpy as np

    rows = [("a", float(v)) for v in (5, 1, 9, 9, 2)] + [("b", 3.0), ("b", None), (None, 1.0), (None, 2.0)]
    got = {r["g"]: (r["q"], r["m"]) for r in A.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q": 0.25, "m": 0.5}).collect()}
    for g in ("a", "b", None):
        own = [v for h, v in rows if h == g and v is not None]
        assert np.allclose(got[g], np.quantile(own, [0.25, 0.5]))
    c = X.four_classes(spark).groupBy("y_true").agg(F.avg((F.col("specialist") == F.col("y_true")).cast("double")).alias("s")).collect()
    assert all(abs(r["s"] - 0.775) < 0.12 for r in c)
    agree = X.four_classes(spark).agg(F.avg((F.col("annotator") == F.col("second")).cast("double"))).first()[0]
    assert 0.8 < agree < 0.95
    p = logs.parse(X.language_log(spark, 4000))
    assert p.count() == 4000 and abs(p.where("level = 'ERROR'").count() / 4000 - 0.08) < 0.02 and p.select("service").distinct().count() == 8
    m = E.flatten(X.messy_inventory(spark, 3000)).groupBy("payload_dept").agg(F.avg(F.col("payload_metrics_rating").isNull().cast("double")).alias("x")).collect()
    assert all(abs(r["x"] - X.FAULTS[r["payload_dept"]]) < 0.03 for r in m)


def test_radius_with_another_metric(spark):
    words = ["kitten", "sitting", "mitten", "bitten", "kit", "ab", "ba"]
    q, v = spark.createDataFrame([("kitten",), ("ab",)], "query string"), spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["query"], r["word"], r["distance"]) for r in Z.radius_search(q, v, 2, F.levenshtein).collect()}
    assert got == {("kitten", "kitten", 0), ("kitten", "mitten", 1), ("kitten", "bitten", 1), ("ab", "ab", 0), ("ab", "ba", 2)}


def test_no_shared_folder(spark, monkeypatch):
    from sparkloom import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
