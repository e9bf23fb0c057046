"""Cleaning of nested, drifting records into a tidy table, and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nested inventory records within one document; the price stands in one of two places.
RECORD = (
    "struct<metadata: struct<internal_id: string, source_node: string>, payload: struct<product_name: string, dept: string, availability: string, "
    "metrics: struct<rating: double, weight_oz: bigint>, history: struct<created_at: string>, price: string, pricing_info: struct<msrp_usd: double, currency: string>>>"
)
DOCUMENT = f"status string, generated_at string, total_count bigint, data_lake_exports struct<inventory_items: array<{RECORD}>>"
NOISE = r"[^\x20-\x7E]"


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as top-level columns a_b_c."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def is_noisy(c: Column) -> Column:
    return c.rlike(NOISE) | c.startswith(" ") | c.endswith(" ")


def strip_noise(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, NOISE, ""))


def parse_currency(c: Column) -> Column:
    """Digits and points only, as a number; null if there is none."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def parse_mixed_date(c: Column) -> Column:
    """Epoch seconds, ISO or US dates; null for all else."""
    return F.coalesce(
        F.timestamp_seconds(c.try_cast("bigint")).cast("timestamp_ntz"),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"),
        F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("timestamp_ntz"),
    )


def noise_report(flat: DataFrame, column: str = "metadata_internal_id") -> DataFrame:
    n = F.count_if(is_noisy(F.col(column)))
    return flat.agg(n.alias("n_noisy"), F.count("*").alias("n_rows"), F.round(F.try_divide(n * 100.0, F.count("*")), 6).alias("pct_noisy"))


def key_usage(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which each of alternative keys is set."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def clean_inventory(flat: DataFrame) -> DataFrame:
    """Flat records with clean id, price (list price first) and launch date; nothing is dropped yet."""
    return flat.select(
        strip_noise(F.col("metadata_internal_id")).alias("id"),
        F.col("payload_product_name").alias("name"),
        F.col("payload_dept").alias("dept"),
        F.coalesce(F.col("payload_pricing_info_msrp_usd"), parse_currency(F.col("payload_price"))).alias("price"),
        F.nanvl(F.col("payload_metrics_rating"), F.lit(None).cast("double")).alias("rating"),
        parse_mixed_date(F.col("payload_history_created_at")).alias("launch_date"),
    )


def tidy(cleaned: DataFrame) -> DataFrame:
    return cleaned.na.drop(subset=["id", "launch_date"])


def audit(cleaned: DataFrame) -> DataFrame:
    """One pass: rows, usable and lost ones, missing ratings, departments, failed prices and dates."""
    usable = F.col("id").isNotNull() & F.col("launch_date").isNotNull()
    return cleaned.agg(
        F.count("*").alias("initial"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("lost"),
        F.count_if(usable & F.col("rating").isNull()).alias("missing_ratings"),
        F.count_distinct(F.when(usable, F.col("dept"))).alias("depts"),
        F.count_if(F.col("price").isNull()).alias("failed_prices"),
        F.count_if(F.col("launch_date").isNull()).alias("failed_dates"),
    )


def matches_safe(c: Column) -> Column:
    """Words apart by single white space. Possessive quantifiers never go back, and loop where greedy groups would recurse once a word."""
    return c.rlike(r"^(?U)\w++(?:\s\w++)*+\s?$")
