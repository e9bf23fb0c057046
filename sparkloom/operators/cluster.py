"""K-Means with fixed rounds, and DBSCAN on cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut, small
from .graph import connected_components


def assign(df: DataFrame, centroids: list[list[float]], vector: str) -> DataFrame:
    """cluster and distance of the nearest centroid; ties go to the lowest index."""
    v = F.col(vector)
    options = F.array(*[F.struct(V.euclidean(v, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return df.withColumn("_m", F.array_min(options)).withColumn("cluster", F.col("_m.i")).withColumn("distance", F.col("_m.d")).drop("_m")


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the mean of each dimension; partial sums by group and dimension, so that no group's rows meet."""
    dims = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def kmeans(df: DataFrame, key: str, vector: str, k: int = 3, rounds: int = 5) -> DataFrame:
    """df with cluster and distance of the last assignment: Lloyd rounds from the k least keys; an empty cluster keeps its centroid.

    Only the k centroids come to the driver.
    """
    centroids = [list(r[vector]) for r in df.orderBy(key).limit(k).select(vector).collect()]
    labelled = df
    for n in range(rounds):
        labelled = assign(df, centroids, vector)
        if n + 1 < rounds:
            for r in mean_pool(labelled, "cluster", vector).collect():
                centroids[r["cluster"]] = list(r["centroid"])
    return labelled


def kmeans_trained(df: DataFrame, key: str, vector: str, k: int = 2, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(key, cluster) by the library's distributed K-Means with its parallel seeding; rows with a null vector are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def purity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(cluster, n, purity): the share of each cluster's rows that have its most frequent truth."""
    return crosstab(df, cluster, truth).groupBy(cluster).agg(F.sum("n").alias("n_rows"), F.max("n").alias("most")).select(cluster, F.col("n_rows").alias("n"), (F.col("most") / F.col("n_rows")).alias("purity"))


def _gaps(limit: float) -> tuple[Column, Column]:
    """Whether all points, or any, of two boxes (a_x0, a_x1, a_y0, a_y1 and b_...) can be in reach. Rounding is monotone, so both hold for the distances as they are computed."""
    c = F.col
    far = [F.greatest(c(f"b_{k}1") - c(f"a_{k}0"), c(f"a_{k}1") - c(f"b_{k}0")) for k in "xy"]
    gap = [F.greatest(c(f"b_{k}0") - c(f"a_{k}1"), c(f"a_{k}0") - c(f"b_{k}1"), F.lit(0.0)) for k in "xy"]
    return far[0] * far[0] + far[1] * far[1] <= limit, gap[0] * gap[0] + gap[1] * gap[1] <= limit


def _boxes(points: DataFrame) -> DataFrame:
    """(cx, cy, node, n, x0, x1, y0, y1, rim): the points of each cell, with the least node among them; rim holds four of them, one at each side."""
    rim = F.array(*[f(F.struct("x", "y")) for f in (F.min, F.max)], *[F.struct(f(F.struct("y", "x"))["x"].alias("x"), f(F.struct("y", "x"))["y"].alias("y")) for f in (F.min, F.max)])
    return points.groupBy("cx", "cy").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), rim.alias("rim"))


def _touch(limit: float) -> Column:
    """Whether two of the points in a_rim and b_rim are in reach."""
    return F.exists("a_rim", lambda p: F.exists("b_rim", lambda q: _reach(p["x"], p["y"], q["x"], q["y"], limit)))


def _components(edges: DataFrame, few: int = 200_000) -> DataFrame:
    """connected_components; so few edges go through one task, as the rounds of jobs would cost far more than that."""
    if edges.limit(few + 1).count() > few:
        return connected_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, kind = {}, None

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a is not None and b is not None and a != b:
                    p, q = top(up.setdefault(a, a)), top(up.setdefault(b, b))
                    up[max(p, q)] = min(p, q)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return cut(edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _around(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """A row of df for each step, with cx and cy that many cells on."""
    at = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))
    return df.withColumn("_at", at).withColumn("cx", F.col("_at.cx")).withColumn("cy", F.col("_at.cy")).drop("_at")


def _cell_links(cores: DataFrame, limit: float, few: int = 256) -> DataFrame:
    """(node, component) of the nodes (one for each cell) whose cells hold points (node, x, y, u, v, cx, cy) in reach; no link of components is missing.

    Boxes about the points of two cells, and the points at their sides, decide most pairs: some are in reach, or none. Others are cut into sixteen parts a cell, as often as
    it takes, and points are compared where two parts have `few` pairs or fewer. Pairs of cells that are connected by now need no more.
    """
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    boxes = cut(_boxes(cores))
    sure, maybe = _gaps(limit)
    sure = sure | _touch(limit)
    a, b = _side(_around(boxes.withColumns({"ox": F.col("cx"), "oy": F.col("cy")}), ahead), "a"), _side(boxes, "b")
    pairs = a.join(b, (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))).withColumns({"a_cx": F.col("a_ox"), "a_cy": F.col("a_oy")}).drop("a_ox", "a_oy")
    edge = [F.col("a_node").alias("a"), F.col("b_node").alias("b")]
    found = cut(pairs.where(maybe).withColumn("sure", sure))
    edges, level = found.where("sure").select(*edge), 0
    while True:
        points = cores.withColumns({"cx": F.floor(F.col("u") * 4.0**level), "cy": F.floor(F.col("v") * 4.0**level)}).select("cx", "cy", "node", "x", "y")
        count = F.col("a_n") * F.col("b_n") if level < 26 else F.lit(0)  # beyond the last bit: parts hold equal points only
        few_pairs = found.where(~F.col("sure") & (count <= few)).select("a_cx", "a_cy", "b_cx", "b_cy")
        near = few_pairs.join(_side(points, "a"), ["a_cx", "a_cy"]).join(_side(points, "b"), ["b_cx", "b_cy"])
        close = _reach(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"), limit)
        edges = cut(edges.unionByName(near.where(close).select(*edge)).distinct())
        comp, left = _components(edges), found.where(~F.col("sure") & (count > few))
        if not left.limit(1).count():
            return comp
        of = lambda c: comp.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_comp"))
        apart = F.coalesce("a_comp", "a_node") != F.coalesce("b_comp", "b_node")
        left = cut(left.join(of("a"), "a_node", "left").join(of("b"), "b_node", "left").where(apart).select(*[F.col(f"{c}_c{k}").alias(f"{c}_p{k}") for c in "ab" for k in "xy"]))
        if not left.limit(1).count():
            return comp
        level += 1
        finer = cores.withColumns({"cx": F.floor(F.col("u") * 4.0**level), "cy": F.floor(F.col("v") * 4.0**level)}).withColumns({"px": F.floor(F.col("cx") / 4), "py": F.floor(F.col("cy") / 4)})
        wanted = left.select(F.col("a_px").alias("px"), F.col("a_py").alias("py")).union(left.select("b_px", "b_py")).distinct()
        parts = cut(_boxes(finer.join(wanted, ["px", "py"], "left_semi")).withColumns({"px": F.floor(F.col("cx") / 4), "py": F.floor(F.col("cy") / 4)}))
        found = cut(left.join(_side(parts, "a"), ["a_px", "a_py"]).join(_side(parts, "b"), ["b_px", "b_py"]).where(maybe).withColumn("sure", sure))
        edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found.where("sure").select(*edge))


def _reach(ax: Column, ay: Column, bx: Column, by: Column, limit: float) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= limit


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float = 1.5, least: int = 5) -> DataFrame:
    """(key, cluster): cluster is the least core point's key, -1 noise. A border point joins the least cluster in reach. Keys are unique.

    Points fall into cells so small that all points of a cell are in reach of each other. So where a cell has `least` points all of them are core,
    and only points of emptier cells are compared with their surroundings: fewer than 24 * least for each point, however
    many it has in reach. Core points of a cell are in one cluster, so that clusters are components of cells. Equal points are one. Points
    without both coordinates, or with infinite ones, are noise; coordinates beyond 2^40 cells are an error.
    """
    side, limit = eps / 1.5, eps * eps
    p = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    spot = p.where(finite).groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    unit = lambda c: F.when(F.abs(F.col(c) / side) < 2.0**40, F.col(c) / side).otherwise(F.raise_error(F.lit(f"{c} is beyond 2^40 cells")).cast("double"))
    spot = cut(spot.withColumns({"u": unit("x"), "v": unit("y")}).withColumns({"cx": F.floor("u"), "cy": F.floor("v")}))
    full = small(spot.groupBy("cx", "cy").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("cx", "cy"))
    dense, sparse = spot.join(full, ["cx", "cy"], "left_semi"), cut(spot.join(full, ["cx", "cy"], "left_anti"))
    ring = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    looking = lambda d: small(_around(d.select(F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy"), ring))
    close = _reach(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"), limit)
    counts = spot.join(looking(sparse), ["cx", "cy"]).where(close).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("n").alias("m"))
    more = counts.where(F.col("m") >= least).select("x", "y")
    core = cut(dense.unionByName(sparse.join(more, ["x", "y"], "left_semi")).where("id IS NOT NULL"))
    nodes = small(core.groupBy("cx", "cy").agg(F.min("id").alias("node")))
    cores = cut(core.join(nodes, ["cx", "cy"]).select("node", "x", "y", "u", "v", "cx", "cy"))
    comp = _cell_links(cores, limit)
    own = cut(cores.join(small(comp), "node", "left").select("x", "y", "cx", "cy", F.coalesce("component", "node").alias("cluster")))
    rest = sparse.join(own.select("x", "y"), ["x", "y"], "left_anti")
    border = own.join(looking(rest), ["cx", "cy"]).where(close).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.min("cluster").alias("cluster"))
    j = p.join(own.select("x", "y", "cluster").unionByName(border), ["x", "y"], "left")
    return j.select(F.col("id").alias(key), F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.coalesce("cluster", F.lit(-1))).cast("bigint").alias("cluster"))


def crosstab(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    return df.groupBy(cluster, truth).agg(F.count("*").alias("n"))


def donut_point(i: str, inner: int = 200, ring: int = 400) -> tuple:
    """Angle and radius by hash: an inner disc, a ring, and scattered noise."""
    from ..functions.numbers import unit

    a, r = unit("angle", F.col(i)) * (2 * math.pi), unit("radius", F.col(i))
    radius = F.when(F.col(i) < inner, r * 5).otherwise(r * 5 + 10)
    kind = F.when(F.col(i) < inner, "inner").when(F.col(i) < inner + ring, "ring").otherwise("noise")
    wide = lambda s: unit(s, F.col(i)) * 40 - 20
    return (
        F.when(kind == "noise", wide("x")).otherwise(radius * F.cos(a)),
        F.when(kind == "noise", wide("y")).otherwise(radius * F.sin(a)),
        kind,
    )
