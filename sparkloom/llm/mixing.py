"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without

#: Up to so many sources the table of rates is broadcast (each at most about 100 KB at a mean rate of 10,000); beyond it is joined.
BROADCAST_SOURCES = 2_000


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed_key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}_"), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, rate, cdf): the mean number of copies of each source's documents and the steps of its Poisson distribution.

    weights: target share of each source, in any unit; None: the same for all. A source without a weight gets none.
    size: expected rows out per row in.
    """
    return rates_of(cut(docs.groupBy("source").agg(F.count("*").alias("n"))), weights, size)


def rates_of(counts: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """rates, from the counts (source, n)."""
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weighted = counts.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("double"), F.lit(0.0)))
    total = weighted.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    rate = F.when(F.col("tw") > 0, F.col("w") / F.col("tw") * F.col("tn") * F.lit(float(size)) / F.col("n")).otherwise(0.0)
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    zero = F.struct((-F.col("rate")).alias("logp"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.log(F.col("rate") / k)
        total = acc["sum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return weighted.crossJoin(F.broadcast(total)).select("source", rate.alias("rate")).select("source", "rate", cdf.alias("cdf"))


def identity(docs: DataFrame) -> Column:
    """What a row's draw and place hash: its doc_id, or its text and source where it has none."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "source") if c in docs.columns]
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null_"), F.md5(F.concat_ws("_", *content))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = "mix") -> DataFrame:
    """Each document as many times as its hash says under a Poisson distribution with its source's rate, in a random order.

    Adds n_copies, copy (from 1) and shuffle_key; columns of these names in docs are replaced. Rows are partitioned by
    the key's hash and sorted by it within partitions. A null source is a source of its own, a row without doc_id draws by its
    text and source, and repeated rows get equal counts. An empty table gives an empty result.
    """
    d = without(docs, "n_copies", "copy", "shuffle_key")
    counts = cut(d.groupBy("source").agg(F.count("*").alias("n")))
    table = rates_of(counts, weights, size).select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf"))
    key = identity(d)
    same = d["source"].eqNullSafe(F.col("__mix_source"))
    if counts.count() <= BROADCAST_SOURCES:
        joined = d.join(F.broadcast(table), same)
    else:  # each rate 16 times, so that no source's documents meet in one task
        salted = table.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = d.withColumn("__mix_salt0", F.pmod(F.xxhash64(key), F.lit(16))).join(salted, same & (F.col("__mix_salt0") == F.col("__mix_salt"))).drop("__mix_salt", "__mix_salt0")
    u = uniform(seed, key)
    n = F.size(F.filter("__mix_cdf", lambda c: c <= u))
    copies = joined.withColumn("n_copies", n).drop("__mix_cdf", "__mix_source").where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}_"), key, F.lit("_"), F.col("copy").cast("string"))))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


#: The same in DuckDB, for equal weights.
ORACLE = """
WITH s AS (SELECT source, count(*) n FROM {docs} GROUP BY source),
r AS (SELECT source, (1.0 / (SELECT count(*) FROM s)) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
c AS (SELECT source, list_transform(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1), lambda k:
        list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma((j + 1)::DOUBLE))))) AS cdf FROM r),
i AS (SELECT d.*, coalesce(d.doc_id::VARCHAR, 'null_' || md5(coalesce(d.text, '') || '_' || coalesce(d.source, ''))) AS ident FROM {docs} d),
u AS (SELECT i.*, ('0x' || substr(md5('mix_' || ident), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM i),
n AS (SELECT u.* EXCLUDE (u), len(list_filter(c.cdf, lambda x: x <= u.u))::INTEGER AS n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source)
SELECT n.* EXCLUDE (ident), k.copy::INTEGER AS copy, md5('mix_' || ident || '_' || k.copy::VARCHAR) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy) k
"""
