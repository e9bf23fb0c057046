"""Classification and agreement metrics over one table of truths and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """tp, fp, fn, tn; labels other than 0 and 1 are not counted."""
    t, p = F.col(truth), F.col(pred)
    return df.agg(*[F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])


def with_scores(c: DataFrame, betas: tuple[float, ...] = (1.0, 2.0, 0.5)) -> DataFrame:
    """accuracy, precision, recall and F-scores; 0 on empty denominators."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    d = c.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    for b in betas:
        d = d.withColumn(f"f{b:g}".replace(".", "_"), ratio((1 + b * b) * p * r, b * b * p + r))
    return d


def sweep(df: DataFrame, truth: str = "y_true", prob: str = "y_prob", steps: int = 100) -> DataFrame:
    """(t, tp, fp, tpr, fpr, precision) at thresholds 0, 1/steps ... 1: a histogram of the scores, then running sums from above.

    Precision is 1 where nothing is predicted. Rows are counted once, whatever the number of thresholds.
    """
    rows = df.where(F.col(truth).isin(0, 1) & F.col(prob).isNotNull())
    bucket = F.least(F.floor(F.col(prob) * steps + 1e-9), F.lit(steps)).cast("bigint")
    h = rows.groupBy(bucket.alias("b")).agg(F.sum(F.col(truth).cast("bigint")).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(steps + 1).withColumnRenamed("id", "b").join(F.broadcast(h), "b", "left").na.fill(0)
    up = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)  # steps + 1 rows
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = grid.select("b", F.sum("p").over(up).alias("tp"), F.sum(F.col("n") - F.col("p")).over(up).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum(F.col("n") - F.col("p")).over(every).alias("neg"))
    return s.select(
        (F.col("b") / steps).alias("t"), "tp", "fp",
        ratio(F.col("tp"), F.col("pos")).alias("tpr"), ratio(F.col("fp"), F.col("neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
    )


def area(points: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area under the points, sorted by x and then y."""
    w = W.orderBy("x", "y")
    p = points.select(F.col(x).alias("x"), F.col(y).alias("y"))
    return p.select(((F.lead("x").over(w) - F.col("x")) * (F.lead("y").over(w) + F.col("y")) / 2).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def curve_areas(sw: DataFrame, gap: float = 0.2) -> DataFrame:
    roc = area(sw, "fpr", "tpr").withColumnRenamed("area", "roc_auc")
    pr = area(sw, "tpr", "precision").withColumnRenamed("area", "pr_auc")
    return roc.crossJoin(pr).withColumn("gap_alert", F.col("roc_auc") - F.col("pr_auc") > gap)


def per_class(df: DataFrame, classes: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(label, tp, fp, fn, f1) of each class of a fixed list, absent ones with zeros; rows are counted by pair once."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    c = df.sparkSession.createDataFrame([(x,) for x in classes], "label string")
    is_t, is_p = F.col("t") == F.col("label"), F.col("p") == F.col("label")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
    g = c.join(pairs, is_t | is_p, "left").groupBy("label").agg(total(is_t & is_p, "tp"), total(is_p & ~F.coalesce(is_t, F.lit(False)), "fp"), total(is_t & ~F.coalesce(is_p, F.lit(False)), "fn"))
    return g.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_micro(df: DataFrame, classes: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    macro = per_class(df, classes, truth, pred).agg(F.avg("f1").alias("macro_f1"))
    return macro.crossJoin(df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("micro_f1")))


def kappa(df: DataFrame, classes: list[str], a: str, b: str) -> DataFrame:
    """Raw agreement and Cohen's kappa; chance agreement over the class list only; 0 without rows, 1 if chance is certain."""
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cols = [F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree")]
    for i, c in enumerate(classes):
        cols += [F.coalesce(F.sum(F.when(F.col("a") == c, F.col("n"))), F.lit(0)).alias(f"a{i}"), F.coalesce(F.sum(F.when(F.col("b") == c, F.col("n"))), F.lit(0)).alias(f"b{i}")]
    s = pairs.agg(*cols)
    n = F.col("total")
    pe: Column = F.lit(0.0)
    for i in range(len(classes)):
        pe = pe + (F.col(f"a{i}") / n) * (F.col(f"b{i}") / n)
    po = F.col("agree") / n
    k = F.when(n.isNull() | (n == 0), 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    return s.select(po.alias("agreement"), k.alias("kappa"))
