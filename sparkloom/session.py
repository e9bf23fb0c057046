"""Session defaults, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get_session(app: str = "sparkloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf entries win (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows: it is counted first, and beyond that the same join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: from 1, each row's place within its group, in ascending order of the given columns.

    Rows are dealt out by ranges of group and order, so that a group of any size is spread over tasks; a row's place is that
    in its partition, less where its group begins there, and the group's counts in the partitions before. Only these
    counts, one for each partition and group within it, are brought together. Groups may be null, and there may be none.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in group + order]).sortWithinPartitions(*group, *order)
    at = cut(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = at.groupBy("_p", *group).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_first", "_before")
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return at.join(small(cut(before)), same).withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
