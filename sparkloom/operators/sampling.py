"""Selection of rows to label: random, stratified, by uncertainty, density, clusters, and cover. Draws are orders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import vectors as V
from ..session import cut, small


def random_sample(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    return df.orderBy(N.hash_order(seed, key), key).limit(n)


def _ranked(df: DataFrame, target: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """The first _k rows of each stratum by hash, with _rn; target: a row for each stratum with _k and its size _n.

    A threshold on the hash, a little above the share that is wanted, keeps all other rows from the shuffle, so a stratum's
    task sorts about _k rows. Should it leave too few of some stratum, which is as good as impossible, all rows are ranked.
    """
    target = small(cut(target.withColumnRenamed(stratum, "_s")))
    share = (F.col("_k") + 6 * F.sqrt("_k") + 20) / F.col("_n")
    upto = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex((F.least(share, F.lit(1.0)) * float(1 << 52)).cast("bigint"))), 13, "0"))
    order = N.hash_order(seed, key)
    joined = df.join(target, F.col(stratum).eqNullSafe(F.col("_s")))
    near = cut(joined.where(order <= upto))
    have = near.groupBy("_s").agg(F.count("*").alias("_c"))
    short = target.join(have.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").where("coalesce(_c, 0) < _k").limit(1).count()
    rows = joined if short else near
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(stratum).orderBy(order, key))).where("_rn <= _k").drop("_s")


def stratified_proportional(df: DataFrame, stratum: str, key: str, budget: int, seed: str = "s") -> DataFrame:
    """round(budget x share) of each stratum, no more than it has; a shortfall is filled from the rest, an overshoot stays."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    target = sizes.crossJoin(F.broadcast(total)).select(stratum, "_n", F.least(F.bround(F.lit(float(budget)) * F.col("_n") / F.col("_t"), 0), F.col("_n")).cast("bigint").alias("_k"))
    picked = _ranked(df, target, stratum, key, seed).drop("_rn", "_k", "_n")
    short = target.agg(F.greatest(F.lit(budget) - F.sum("_k"), F.lit(0)).alias("_s"))
    few = df.join(picked.select(key), key, "left_anti").orderBy(N.hash_order(seed, key), key).limit(budget)
    fill = few.withColumn("_r", F.row_number().over(W.orderBy(N.hash_order(seed, key), key))).crossJoin(F.broadcast(short)).where("_r <= _s").drop("_r", "_s")
    return picked.unionByName(fill.select(*picked.columns))


def stratified_minimum(df: DataFrame, stratum: str, key: str, budget: int, least: int, seed: str = "s") -> DataFrame:
    """min(least, size) of each stratum first; the remaining budget goes by remaining sizes; at most `budget` rows, strata in name order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n")).withColumn("_m", F.least(F.col("_n"), F.lit(least)))
    total = sizes.agg(F.sum("_m").alias("_tm"), F.sum(F.col("_n") - F.col("_m")).alias("_tr"))
    more = F.when(F.col("_tr") > 0, F.bround(F.greatest(F.lit(budget) - F.col("_tm"), F.lit(0)) * (F.col("_n") - F.col("_m")) / F.col("_tr"), 0)).otherwise(0)
    target = sizes.crossJoin(F.broadcast(total)).select(stratum, "_n", "_m", F.least(F.col("_m") + more, F.col("_n")).cast("bigint").alias("_k"))
    chosen = _ranked(df, target, stratum, key, seed)
    phase = (F.col("_rn") > F.col("_m")).cast("int")
    return chosen.orderBy(phase, stratum, "_rn").limit(budget).drop("_rn", "_m", "_k", "_n")


def class_report(sample: DataFrame, classes: DataFrame, stratum: str, enough: int) -> DataFrame:
    """Count and share of each class, none included, and whether there are too few."""
    c = sample.groupBy(stratum).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    j = classes.join(c, stratum, "left").crossJoin(F.broadcast(t)).withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return j.select(stratum, "n", F.coalesce(F.col("n") * 100.0 / F.col("t"), F.lit(0.0)).alias("pct"), (F.col("n") < enough).alias("insufficient"))


def margin(probs: Column) -> Column:
    s = F.sort_array(probs, asc=False)
    return s[0] - s[1]


def entropy(probs: Column) -> Column:
    return F.aggregate(F.filter(probs, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def disagreement(values: Column) -> Column:
    """Sample variance of the committee's probabilities; 0 for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n < 2, 0.0).otherwise(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))


def uncertainty(prob: Column) -> Column:
    return 1 - 2 * F.abs(prob - 0.5)


def top(df: DataFrame, score: Column, key: str, n: int, ascending: bool = False) -> DataFrame:
    d = df.withColumn("score", score)
    return d.orderBy(F.asc("score") if ascending else F.desc("score"), key).limit(n)


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, other, distance): the k nearest other points of each query, of a stated set; the points meet the queries in blocks of bounded size."""
    p = points.select(F.col(key).alias("other"), F.col(vector).alias("_w"))
    d = V.in_blocks(queries.select(F.col(key), F.col(vector).alias("_v")), key, p).where(F.col("other") != F.col(key)).select(key, "other", V.euclidean(F.col("_v"), F.col("_w")).alias("distance"))
    return d.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy("distance", "other"))).where(F.col("_rn") <= k).drop("_rn")


def density(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(key, density): inverse mean distance to the k nearest, scaled to [0, 1] over the queries (0 if all are equal)."""
    g = nearest(queries, points, key, vector, k).groupBy(key).agg((1.0 / (F.avg("distance") + 0.001)).alias("raw"))
    ends = g.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return g.crossJoin(F.broadcast(ends)).select(key, N.ratio(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")).alias("density"))


def hybrid(u: Column, d: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return F.pow(u, F.lit(alpha)) * F.pow(d, F.lit(beta))


def by_distance(df: DataFrame, cluster: str, key: str, distance: str, n: int, farthest: bool = False) -> DataFrame:
    """The n nearest, or farthest, rows of each cluster."""
    order = F.desc(distance) if farthest else F.asc(distance)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(cluster).orderBy(order, key))).where(F.col("rank") <= n)


def core_set(df: DataFrame, key: str, vector: str, budget: int) -> DataFrame:
    """(key, pick): greedy farthest points, beginning with the least key; ties go to the least key. One pass for each pick."""
    spark = df.sparkSession
    d = df.select(key, F.col(vector).cast("array<double>").alias("_v"))
    first = d.orderBy(key).limit(1).collect()
    picks: list[tuple] = []
    d = d.withColumn("_d", F.lit(float("inf")))
    now = first[0] if first else None
    while now is not None and len(picks) < budget:
        picks.append((now[key], len(picks) + 1))
        centre = F.array(*[F.lit(float(x)) for x in now["_v"]])
        d = d.where(F.col(key) != now[key]).withColumn("_d", F.least("_d", V.euclidean(F.col("_v"), centre)))
        if len(picks) % 8 == 0:
            d = cut(d)
        best = d.orderBy(F.desc("_d"), key).limit(1).collect()  # one row
        now = best[0] if best else None
    return spark.createDataFrame(picks, f"{key} bigint, pick bigint") if picks else spark.createDataFrame([], f"{key} bigint, pick bigint")
