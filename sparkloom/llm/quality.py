"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, labelled, pool_adjacent

#: Byte classes: 0 other ASCII signs, 1 lower, 2 upper, 3 digit, 4 space, 5 beyond ASCII, 6 sentence marks, 7 line feed.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[[32, 9, 11, 12, 13]], CLASSES[128:], CLASSES[10] = 1, 2, 3, 4, 5, 7
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 6
TAIL = re.compile(rb"[^\w\s\x80-\xff]{2,}(?=\s|$)")
N_FEATURES = 18


def statistics(text: str | None) -> list[float]:
    """What a score sees of a whole text: lengths, byte classes, word variety and repetition, lines; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    n, m = len(raw), len(words)
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=8) / n
    counts = Counter(words)
    lines = raw.split(b"\n")
    adjacent = sum(map(bytes.__eq__, words, words[1:])) / m
    long_words = sum(len(w) > 20 for w in words) / m
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / m / 10, *kinds[[0, 1, 2, 3, 5, 6]].tolist(),
        len(counts) / m, max(counts.values()) / m, adjacent, pairs, long_words,
        len(set(lines)) / len(lines), float(np.log1p(m / len(lines))), len(TAIL.findall(raw)) / m, counts[b"|"] / m,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, f array<double>")


@dataclass
class Model:
    """Standardisation, the Fourier features' frequencies and phases, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        rff = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([rff, np.clip(z, -8, 8) * 0.1, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of it follows the raw one, so that a step's rows keep their order."""
        r = self.raw(x)
        y = self.ys[np.minimum(np.searchsorted(self.xs, r), len(self.ys) - 1)]
        return np.clip(0.999 * y + 0.001 * np.clip(r, 0, 1), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_FEATURES)


def train(feats: DataFrame, labels: DataFrame, label: str = "quality", dim: int = 256, width: float = 4.0, ridge: float = 1e-3, parts: tuple[int, int] = (16, 64), seed: int = 7) -> Model:
    """Fit from every labelled row outside fold 2: folds 0 and 1 give the ridge weights, fold 3 the calibration.

    A task for each 100,000 rows, within the bounds of `parts`, sums the normal equations of its rows; the driver adds these
    matrices of a fixed size (0.6 MB). The calibration pools steps of the raw score, from -1 to 2. Without labels every score is 1/2; with one class all
    scores lie near it.
    """
    rows = cut(feats.join(labelled(labels, label), "doc_id").select("f", "fold", "y"))
    fit = rows.where("fold <> 3")
    sums = fit.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("f")[k]).alias(f"m{k}") for k in range(N_FEATURES)],
        *[F.stddev_pop(F.col("f")[k]).alias(f"s{k}") for k in range(N_FEATURES)],
    ).first()
    rng = np.random.default_rng(seed)
    empty = not sums["n"]
    mean = np.array([0.0 if empty else sums[f"m{k}"] for k in range(N_FEATURES)])
    scale = np.array([1.0 if empty else max(sums[f"s{k}"], 1e-3) for k in range(N_FEATURES)])
    size = dim + N_FEATURES + 1
    model = Model(mean, scale, rng.normal(size=(N_FEATURES, dim)) / width, rng.uniform(0, 2 * np.pi, dim), np.zeros(size), np.array([0.0]), np.array([0.5]))
    if empty:
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for x in batches:
            if x.num_rows:
                z, y = model.map(matrix(x.column(0))), np.asarray(x.column(1))
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, b]).tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((size + 1, size))
    for r in fit.select("f", "y").repartition(max(parts[0], min(parts[1], sums["n"] // 100_000))).mapInArrow(normal, "sums binary").collect():
        total += np.frombuffer(r["sums"]).reshape(size + 1, size)
    model.weights = np.linalg.solve(total[:-1] + ridge * max(1, sums["n"]) ** 0.5 * np.eye(size), total[-1])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(x.column(0)))), x.column(1)], names=["x", "y"])

    steps = rows.where("fold = 3").select("f", "y").mapInArrow(rate, "x double, y double").groupBy(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.ceil(F.col("x") * 200) / 200)).alias("x")).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    points = [(r["x"], r["s"], r["n"]) for r in steps.collect()]  # at most 601
    if points:
        xs, ys = pool_adjacent(points)
        model.xs, model.ys = np.array(xs), np.array(ys)
    else:
        model.xs, model.ys = np.linspace(0, 1, 101), np.linspace(0, 1, 101)
    return model


def score_quality(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score(matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id bigint, score double")


def op1_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score and decision of each row; null and empty texts are scored by their (zero) statistics. Repeated rows stay; rows without
    doc_id keep a null id and are not held out."""
    feats = cut(features(docs))
    return score_quality(feats, train(feats, labels)).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
