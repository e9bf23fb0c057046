"""Log forensics: parsing, banned actors, and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import numbered

ENTRY = "ip_address string, timestamp bigint, status string, meta string"


def failures(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ip_address, timestamp) of failure lines; a cheap substring test goes before the parse. Malformed lines and those without address are skipped."""
    j = F.from_json(column, ENTRY)
    return (
        lines.where(F.col(column).contains("FAILURE")).select(j.alias("j")).where("j.status = 'FAILURE' AND j.ip_address IS NOT NULL AND j.timestamp IS NOT NULL").select("j.ip_address", "j.timestamp")
    )


def banned(df: DataFrame, actor: str, day: Column, threshold: int = 50) -> DataFrame:
    """Distinct actors with more than `threshold` rows on one day."""
    return df.groupBy(actor, day.alias("day")).agg(F.count("*").alias("n")).where(F.col("n") > threshold).select(actor).distinct()


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(date, level, service, ms) of lines with three fields or more and a service; ms is the first number before `ms`."""
    f = F.filter(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " "), lambda x: x != "")
    service = F.regexp_extract(column, r"service=(\S+)", 1)
    return lines.where((F.size(f) >= 3) & (service != "")).select(
        f[0].alias("date"),
        F.regexp_replace(f[2], r"^[\[\]]+|[\[\]]+$", "").alias("level"),
        service.alias("service"),
        F.regexp_extract(column, r"(\d+)ms\b", 1).try_cast("bigint").alias("ms"),
    )


def tokens_with(lines: DataFrame, prefix: str, column: str = "value") -> DataFrame:
    """(token) of each white-space token that begins with the prefix."""
    return lines.select(F.explode(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")).alias("token")).where(F.col("token").startswith(prefix))


def rollup(parsed: DataFrame) -> DataFrame:
    """One pre-aggregate by service and date, from which all three reports follow."""
    return parsed.groupBy("service", "date").agg(
        F.count("*").alias("lines"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.sum("ms").alias("ms_sum"), F.count("ms").alias("ms_count")
    )


def errors_by_service(r: DataFrame) -> DataFrame:
    return r.groupBy("service").agg(F.sum("errors").alias("errors")).where("errors > 0").orderBy(F.desc("errors"), "service")


def latency_by_service(r: DataFrame) -> DataFrame:
    g = r.groupBy("service").agg(F.sum("ms_sum").alias("s"), F.sum("ms_count").alias("c")).where("c > 0")
    return g.select("service", (F.col("s") / F.col("c")).alias("mean_ms")).orderBy(F.desc("mean_ms"), "service")


def error_rate_by_date(r: DataFrame) -> DataFrame:
    g = r.groupBy("date").agg(F.sum("errors").alias("e"), F.sum("lines").alias("n"))
    return g.select("date", (F.col("e") * 100.0 / F.col("n")).alias("error_rate")).orderBy("date")


def batches(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    """batch: number of the fixed-size batch in a given order. A window without partition keys would bring all rows to one task; numbered does not."""
    return numbered(df, [], [order], "_i").withColumn("batch", F.floor((F.col("_i") - 1) / size)).drop("_i")
