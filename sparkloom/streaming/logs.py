"""Structured Streaming forms of the log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def banned_stream(events: DataFrame, actor: str = "user_id", ts: str = "ts", threshold: int = 50, late: str = "1 day") -> DataFrame:
    """Actors with more than `threshold` rows in a UTC day, with state dropped `late` after the day's end."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", "1 day").alias("w"), actor).agg(F.count("*").alias("n")).where(F.col("n") > threshold).select(F.to_date("w.start").alias("day"), actor, "n")


def error_lines(lines: DataFrame, word: str = "ERROR") -> DataFrame:
    return lines.where(F.col("value").contains(word))


def run_to_end(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All available input: the last state of each row that the stream updated, windows that are still open at the end included.

    Each batch's updates go to a folder of its own below the shared one, so that a batch that is run again replaces its
    own; `n` grows, so the greatest one is the last.
    """
    out = scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    keys = [c for c in stream.columns if c != "n"]
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out).groupBy(*keys).agg(F.max("n").alias("n"))
