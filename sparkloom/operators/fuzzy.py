"""Fuzzy text: stems, edit distances, deletion-variant lookup, and radius search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def osa(a: str, b: str) -> int:
    """Edits to get from a to b: insert, delete, replace, or swap two neighbours that are not edited again."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def osa_distance(a: Column, b: Column) -> Column:
    """osa of two columns, null where either is; Spark has no built-in form, so Arrow batches go to Python, where a block of pairs is computed at once."""

    @F.pandas_udf("int")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = pd.array([None] * len(x), dtype="Int32")
        out[there] = osa_block(x[there].tolist(), y[there].tolist())
        return pd.Series(out)

    return f(a, b)


def osa_block(a: list[str], b: list[str], cells: int = 1 << 22) -> np.ndarray:
    """osa of each a with its b: one table of all pairs of a block, filled row by row and, within a row, by running minima.

    Pairs are taken by length, in blocks whose code points fill up to `cells`, so that long texts need no more memory.
    """
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out, order = np.zeros(len(a), np.int64), np.lexsort((la, lb)) if len(a) else []
    at = 0
    while at < len(a):
        step = max(1, min(len(a) - at, cells // (int(lb[order[at]]) + 2)))
        while step > 1 and (int(max(lb[order[at : at + step]].max(), la[order[at : at + step]].max())) + 2) * step > cells:
            step //= 2
        pick = order[at : at + step]
        at += step
        n, m = int(la[pick].max()), int(lb[pick].max())
        codes = lambda texts, width: np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), (0, width - len(t))) for t in texts]).reshape(len(texts), width)
        x, y = codes([a[i] for i in pick], n), codes([b[i] for i in pick], m)
        along = np.arange(m + 1)
        last = np.tile(along, (len(pick), 1))
        before = last
        out[pick[la[pick] == 0]] = lb[pick[la[pick] == 0]]
        for i in range(1, n + 1):
            now = np.empty_like(last)
            now[:, 0] = i
            now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (x[:, i - 1, None] != y))
            if i > 1 and m > 1:
                swap = (x[:, i - 1, None] == y[:, :-1]) & (x[:, i - 2, None] == y[:, 1:])
                now[:, 2:] = np.where(swap, np.minimum(now[:, 2:], before[:, :-2] + 1), now[:, 2:])
            now = np.minimum.accumulate(now - along, axis=1) + along  # insertions
            done = la[pick] == i
            out[pick[done]] = now[done, lb[pick[done]]]
            before, last = last, now
    return out


def word_frequency(df: DataFrame, word: str, count: str | None = None) -> DataFrame:
    n = F.sum(count) if count else F.count("*")
    return df.where(F.col(word).isNotNull()).groupBy(F.lower(word).alias("word")).agg(n.cast("bigint").alias("freq"))


def variants(words: DataFrame, word: str, distance: int = 1) -> DataFrame:
    return words.withColumn("variant", F.explode(T.deletions(F.col(word), distance)))


def deletion_lookup(queries: DataFrame, vocabulary: DataFrame, distance: int = 1) -> DataFrame:
    """(query, word, freq, rank): words with a common deletion variant, by frequency; distances are not checked again."""
    q = variants(queries.select(F.lower("query").alias("query")).distinct(), "query", distance)
    v = variants(vocabulary.select("word", "freq"), "word", distance)
    hits = q.join(v, "variant").select("query", "word", "freq").distinct()
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("freq"), "word")))


def radius_search(queries: DataFrame, vocabulary: DataFrame, radius: int = 1, metric: Callable[[Column, Column], Column] = osa_distance) -> DataFrame:
    """(query, word, distance) of all words within the radius: candidates share a deletion variant, pairs of words of up to
    radius letters, which may share only the empty one, are added, and the distance is checked.

    metric: any distance that is never below osa_distance, as F.levenshtein; the candidates hold for those.
    """
    q, v = queries.select("query").distinct(), vocabulary.select("word").distinct()
    shared = variants(q, "query", radius).join(variants(v, "word", radius), "variant").select("query", "word")
    short = q.where(F.length("query") <= radius).join(v.where(F.length("word") <= radius), F.lit(True)).select("query", "word")
    found = shared.unionByName(short).distinct()
    return found.withColumn("distance", metric(F.col("query"), F.col("word"))).where(F.col("distance") <= radius)
