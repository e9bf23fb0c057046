"""Department statistics, outliers, calendars of launches, and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, numbered, small


def with_cost(df: DataFrame, cost: DataFrame, overpriced: str = "ID_100") -> DataFrame:
    """Join of a cost table (id, unit_cost); one known id costs half again its price."""
    j = df.join(cost, "id", "left")
    return j.withColumn("unit_cost", F.when(F.col("id") == overpriced, F.col("price") * 1.5).otherwise(F.col("unit_cost")))


def enrich(df: DataFrame) -> DataFrame:
    """Department mean and sample deviation of the price, z-score (null for constant or single ones), profit, margin."""
    stats = small(df.groupBy("dept").agg(F.avg("price").alias("dept_avg_price"), F.stddev_samp("price").alias("dept_std_price")))
    joined = df.join(stats.withColumnRenamed("dept", "_dept"), F.col("dept").eqNullSafe(F.col("_dept"))).drop("_dept")
    return (
        joined.withColumn("price_zscore", F.try_divide(F.col("price") - F.col("dept_avg_price"), F.col("dept_std_price")))
        .withColumn("unit_profit", F.col("price") - F.col("unit_cost"))
        .withColumn("margin_pct", F.try_divide(F.col("unit_profit"), F.col("price")) * 100)
    )


def dept_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("dept").agg(
        F.count("id").alias("product_count"),
        F.bround(F.avg("price"), 2).alias("avg_price"),
        F.bround(F.avg("rating"), 2).alias("avg_rating"),
        F.bround(F.avg("margin_pct"), 2).alias("avg_margin"),
        F.bround(F.coalesce(F.sum(F.when(F.col("unit_profit") < 0, F.col("unit_profit"))), F.lit(0.0)), 2).alias("total_loss"),
    )


def margin_alerts(stats: DataFrame, below: float = 15.0) -> DataFrame:
    return stats.where(F.col("avg_margin") < below)


def hidden_gems(df: DataFrame, rating: float = 4.5, z: float = -1.0):
    return df.where((F.col("rating") >= rating) & (F.col("price_zscore") < z))


def loss_leaders(df: DataFrame) -> DataFrame:
    return df.where("unit_profit < 0").orderBy("unit_profit", "id")


def outliers(df: DataFrame, z: float = 2.0) -> DataFrame:
    return df.groupBy("dept").agg(F.count_if(F.abs("price_zscore") > z).alias("n_outliers"))


def calendar(df: DataFrame, group: str, date: str, unit: str) -> DataFrame:
    """(group, bucket, n): rows of each month or week (named by its last day, Sunday) from a group's first to its last; none: 0."""
    d = F.to_date(date)
    if unit == "month":
        bucket, step = F.trunc(d, "month"), "INTERVAL 1 MONTH"
    else:
        bucket, step = F.next_day(F.date_sub(d, 1), "SUN"), "INTERVAL 7 DAY"
    counts = df.where(F.col(date).isNotNull()).groupBy(group, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    spine = counts.groupBy(group).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(group, F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    out = spine.join(counts, [group, "bucket"], "left").select(group, "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return out.withColumn("bucket", F.last_day("bucket")) if unit == "month" else out


def wide(df: DataFrame, index: str, column: str, value: str, values: list[str]) -> DataFrame:
    """One column for each of the given values; missing cells are 0."""
    return df.groupBy(index).pivot(column, values).agg(F.first(value)).na.fill(0)


def monthly_rating(df: DataFrame, bleed: bool = False) -> DataFrame:
    """Mean rating of each department and month, empty months filled from before; bleed: across departments too."""
    m = df.groupBy("dept", F.trunc(F.to_date("launch_date"), "month").alias("month")).agg(F.avg("rating").alias("r"))
    spine = m.groupBy("dept").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("dept", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    full = spine.join(m, ["dept", "month"], "left")
    order = W.orderBy("dept", "month") if bleed else W.partitionBy("dept").orderBy("month")
    return full.select("dept", "month", F.last("r", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("rating"))


def rating_decay(monthly: DataFrame, alert: float = -0.1) -> DataFrame:
    """The last month's rating against the mean of all before it; departments of one month are left out."""
    rn = F.row_number().over(W.partitionBy("dept").orderBy(F.desc("month")))
    g = monthly.withColumn("rn", rn).groupBy("dept").agg(
        F.max(F.when(F.col("rn") == 1, F.col("rating"))).alias("latest"), F.avg(F.when(F.col("rn") > 1, F.col("rating"))).alias("before"), F.count("*").alias("months")
    )
    d = F.col("latest") - F.col("before")
    return g.where("months >= 2").select("dept", "latest", "before", d.alias("delta"), (d < alert).alias("is_decaying"))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): exact quantiles, with linear interpolation between neighbours; nulls are left out.

    Rows are numbered over ranges, so no task holds a group; of each group the few rows about the quantiles are kept.
    """
    ranked = numbered(df.where(F.col(value).isNotNull()).select(group, value), [group], [value], "_i")
    sizes = ranked.groupBy(group).agg(F.max("_i").alias("_n"))
    j = ranked.join(small(sizes.withColumnRenamed(group, "_g")), F.col(group).eqNullSafe(F.col("_g")))
    out = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * share + 1
        low = F.floor(at)
        part = F.when(F.col("_i") == low, F.col(value) * (low + 1 - at)).when(F.col("_i") == low + 1, F.col(value) * (at - low))
        out.append(F.sum(part).alias(name))
    return j.groupBy(group).agg(*out)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and the whiskers: the outermost values within 1.5 interquartile ranges of the box."""
    q = quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        df.join(small(cut(q)), group)
        .groupBy(group, "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("n_fliers"))
    )


def kde(df: DataFrame, group: str, value: str, points: int = 25) -> DataFrame:
    """Gaussian density of each group on an even grid over its range, with Scott's bandwidth.

    Values are first counted, so that each distinct one meets each of the `points` grid places once.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("w"))
    s = df.groupBy(group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("sd > 0")
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)).alias("x"))))
    z = (F.col("g.x") - F.col(value)) / F.col("h")
    return (
        counts.join(small(s), group)
        .withColumn("g", grid)
        .groupBy(group, F.col("g.i").alias("i"), F.col("g.x").alias("x"))
        .agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h")) / 2.5066282746310002).alias("density"))
    )


def scatter(df: DataFrame) -> DataFrame:
    gem = F.coalesce((F.col("rating") >= 4.5) & (F.col("price_zscore") < -1.0), F.lit(False))
    return df.select("id", "dept", "price", "rating", gem.alias("is_gem"))


def leaders(df: DataFrame) -> DataFrame:
    """The department with the highest mean margin, and that with most launches; ties go to the first name."""
    g = df.groupBy("dept").agg(F.avg("margin_pct").alias("m"), F.count("*").cast("double").alias("c"))
    pick = lambda name, by: g.orderBy(F.desc_nulls_last(by), "dept").limit(1).select(F.lit(name).alias("what"), "dept", F.col(by).alias("value"))
    return pick("most_profitable", "m").unionByName(pick("most_active", "c"))
