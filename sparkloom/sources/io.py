"""Sources and sinks: nested JSON documents, JSON lines, text lines, directories of texts, sorted text files, parquet stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.etl import DOCUMENT


def read_document(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Records within one JSON document; the schema is declared, so that no pass is spent on finding it."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data_lake_exports.inventory_items").alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Objects of JSON lines; lines that are not objects are skipped."""
    j = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return lines.where(F.trim(column).startswith("{")).select(j.alias("j")).where("j IS NOT NULL").select("j.*")


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(doc_id, text) of each file; doc_id is its name without suffix."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, f"{suffix.replace('.', '[.]')}$", "").alias("doc_id"), F.col("value").alias("text"))


def write_json(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines; by: columns whose values get a folder each."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_sorted_text(df: DataFrame, column: str, path: str) -> None:
    """One value a line, in global order over the part files; a single file only if Spark makes one partition of it."""
    df.select(F.col(column).cast("string")).orderBy(column).write.mode("overwrite").text(path)


def write_sharded(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Equal keys in one file each, for consumers that need that; within Spark the shuffle does it."""
    df.repartition(shards, key).write.mode("overwrite").json(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write and read again, with types kept."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shard_count(size: int, ram: int, share: float = 0.05, limit: int = 1014) -> int:
    """Files that a single machine would need for the failing share of an input; Spark itself sizes partitions at run time."""
    n = int(size * share // max(ram * 0.5, 1024)) + 1
    if size > 0:
        n = max(n, 2)
    if n > limit:
        raise ValueError(f"{n} shards are more than {limit} open files")
    return n
