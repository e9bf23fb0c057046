"""Keyword retrieval: positional postings, TF-IDF and BM25, Boolean and phrase search, synonyms, rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import numbered, small

K1, B = 1.25, 0.8
#: Up to so many query terms are broadcast (about 100 bytes each).
BROADCAST_TERMS = 200_000


def positions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.posexplode(T.tokens(F.col(text))).alias("pos", "term"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc_id, tf, positions), positions ascending."""
    return positions(df, key, text).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.size(T.tokens(F.col(text))), F.lit(0)).cast("bigint").alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length (0 if empty)."""
    return dl.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))


def idf(n_docs, df):
    return F.when(df == 0, 0.0).otherwise(F.log(1 + (n_docs - df + 0.5) / (df + 0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct, of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))


def expand(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms and their synonyms (term, synonym)."""
    return terms.unionByName(terms.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))).distinct()


def search(df: DataFrame, key: str, text: str, terms: DataFrame, model: str = "bm25", whole: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of documents with any of the terms. whole: for use of all ranks, which are then numbered over
    ranges, so that no task holds the list of a query; else a limit on the rank reaches the window.

    The documents' tokens meet the distinct query terms before they are counted, so only matching tokens are shuffled.
    """
    wanted = terms.select("term").distinct()
    hits = positions(df, key, text).join(small(wanted, BROADCAST_TERMS), "term")
    tf = hits.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    freq = tf.groupBy("term").agg(F.count("*").alias("df"))
    dl = lengths(df, key, text)
    j = tf.join(freq, "term").join(dl, "doc_id").crossJoin(F.broadcast(corpus_stats(dl)))  # one row
    w = idf(F.col("n_docs"), F.col("df"))
    if model == "bm25":
        w = w * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    else:
        w = w * F.col("tf")
    scored = j.withColumn("w", w).join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    if whole:
        return numbered(scored.withColumn("_s", -F.round("score", 9)), ["query_id"], ["_s", "doc_id"], "rank").drop("_s")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")))


def all_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents with every term of the query."""
    n = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    have = positions(df, key, text).select("doc_id", "term").distinct().join(small(terms, BROADCAST_TERMS), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("m"))
    return have.join(n, "query_id").where("m = n").select("query_id", "doc_id")


def phrase(df: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, n): documents in which the query's tokens stand one after the other, and how often; none for an empty query."""
    q = queries.select("query_id", T.tokens(F.col("query")).alias("q")).select("query_id", F.size("q").alias("len"), F.posexplode("q").alias("at", "term"))
    p = positions(df, key, text).join(small(q, BROADCAST_TERMS), "term")
    runs = p.groupBy("query_id", "doc_id", (F.col("pos") - F.col("at")).alias("base")).agg(F.count("*").alias("m"), F.first("len").alias("len")).where("m = len")
    return runs.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


def fuse(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, rrf): sums of 1 / (rank + k) over two rankings."""
    u = first.select("query_id", "doc_id", "rank").unionByName(second.select("query_id", "doc_id", "rank"))
    return u.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.col("rank") + k)).alias("rrf"))
