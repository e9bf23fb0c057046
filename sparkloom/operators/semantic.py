"""Vector search: cosine top-k, chunks, lookup encoding, and the best sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

FALLBACK = [0.1] * 5


def cosine_topk(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query_id, key, cosine, rank): the k points nearest by angle to each of a stated set of queries, itself excepted; queries in blocks."""
    q = queries.select(F.col(key).alias("query_id"), V.as_double(F.col(vector)).alias("_q")).withColumn("_nq", V.norm(F.col("_q")))
    p = points.select(key, V.as_double(F.col(vector)).alias("_p")).withColumn("_np", V.norm(F.col("_p")))
    c = F.when(F.col("_nq") * F.col("_np") == 0, 0.0).otherwise(V.dot(F.col("_q"), F.col("_p")) / (F.col("_nq") * F.col("_np")))
    s = V.in_blocks(q, "query_id", p).where(F.col("query_id") != F.col(key)).select("query_id", key, c.alias("cosine"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key))).where(F.col("rank") <= k)


def chunk(df: DataFrame, key: str, text: str, size: int = 6, overlap: int = 2) -> DataFrame:
    return df.select(key, F.posexplode(T.chunks(F.col(text), size, overlap)).alias("chunk_no", "chunk"))


def encode(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """df with vector: that of the trimmed lower-case text in the dictionary (text, embedding), or the fallback."""
    d = dictionary.select(F.lower(F.trim("text")).alias("_key"), F.col("embedding").alias("_e")).dropDuplicates(["_key"])
    e = df.withColumn("_key", F.lower(F.trim(text))).join(d, "_key", "left")
    return e.withColumn("vector", F.coalesce("_e", F.array(*[F.lit(x) for x in FALLBACK]))).drop("_key", "_e")


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, sentence): pieces between full stops, trimmed, without empty ones."""
    s = df.select(key, F.posexplode(F.transform(F.split(text, r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))).alias("no", "sentence"))
    return s.where("sentence <> ''")


def best_sentence(df: DataFrame, key: str, text: str, dictionary: DataFrame, query: list[float]) -> DataFrame:
    """(key, sentence, score): the sentence of each document that is nearest to the query, the first on ties."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = encode(sentences(df, key, text), "sentence", dictionary).withColumn("score", V.cosine(F.col("vector"), q))
    best = s.groupBy(key).agg(F.min_by(F.struct("sentence", "score"), F.struct((-F.round("score", 9)).alias("s"), F.col("no"))).alias("b"))
    return best.select(key, "b.sentence", "b.score")


def lexical_overlap(a, b):
    """Number of common words of two texts."""
    return F.size(F.array_intersect(F.array_distinct(T.words(F.lower(a))), F.array_distinct(T.words(F.lower(b)))))
