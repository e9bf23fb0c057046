"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch, shared_dir, table

__all__ = ["bind", "cut", "fold_of", "labelled", "pool_adjacent", "scratch", "shared_dir", "table", "without"]

def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though use names it in lambdas, where the optimizer may inline it for each element."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, whatever their case: an operator's own output columns win."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out everywhere."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, fold) of the rows one may learn from: no null, not of fold 2, one row per document (1 wins over 0)."""
    return (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .withColumn("fold", fold_of(F.col("doc_id")))
        .where("fold <> 2")
        .groupBy("doc_id", "fold")
        .agg(F.max("y").alias("y"))
    )


def pool_adjacent(points: list[tuple[float, float, float]], prior: float = 1.0) -> tuple[list[float], list[float]]:
    """Isotonic regression of (x, sum of y, weight), by pooling adjacent violators: ascending x of each block's last point, and its value.

    Each block's mean is drawn towards one half by `prior` pseudo-rows, so that no score is exactly 0 or 1.
    """
    blocks: list[list[float]] = []
    for x, s, n in sorted(points):
        blocks.append([x, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x, s, n = blocks.pop()
            blocks[-1] = [x, blocks[-1][1] + s, blocks[-1][2] + n]
    values: list[float] = []
    for _, s, n in blocks:
        values.append(max((s + prior / 2) / (n + prior), values[-1] if values else 0.0))
    return [b[0] for b in blocks], values
