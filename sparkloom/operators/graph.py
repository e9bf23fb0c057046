"""Connected components of an edge table, without bringing an edge to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node that can be reached.

    The graph shrinks round by round. Each node takes its smallest neighbour, or itself, and follows that choice four
    steps; edges are then renamed to the choices, and those within one are gone. Every choice stays within the component, and its
    smallest node chooses itself, so it is the one that is left. Every round is written to the shared folder. Nulls
    and loops are ignored; an empty edge table gives an empty result; repeated edges change nothing.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while e.limit(1).count():
        to = e.groupBy(F.col("a").alias("x")).agg(F.least(F.col("x"), F.min("b")).alias("y"))
        for _ in range(2):
            to = cut(to)
            to = to.join(to.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))
        to = cut(to)
        labels = cut(labels.join(to.withColumnRenamed("x", "component"), "component", "left").select("node", F.coalesce("y", "component").alias("component")))
        a, b = to.select(F.col("x").alias("a"), F.col("y").alias("na")), to.select(F.col("x").alias("b"), F.col("y").alias("nb"))
        e = cut(e.join(a, "a").join(b, "b").where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    return labels
