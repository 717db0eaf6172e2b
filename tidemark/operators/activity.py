"""Statistics of an activity log: who did something to which item, where and when. Columns' roles are arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import moment, positive_only, signed_error, year_of


def activity_stats(df: DataFrame, key: str, actor: str, value: str, approximate: bool = False) -> DataFrame:
    """Actions, distinct actors, the sum of positive values (null if there is none) and the mean of all values, by key. Null actors don't
    count as actors. approximate adds a HyperLogLog count of actors."""
    aggs = [F.count("*").alias("actions"), F.count_distinct(actor).alias("actors"), F.sum(positive_only(F.col(value))).alias("volume"), F.avg(value).alias("mean_value")]
    return df.groupBy(key).agg(*aggs, *([F.approx_count_distinct(actor).alias("actors_hll")] if approximate else []))


def top_items(df: DataFrame, key: str, item: str, actor: str, n: int = 20) -> DataFrame:
    """The n items of each key with the most actions, ties by item."""
    counts = df.groupBy(key, item).agg(F.count("*").alias("actions"), F.count_distinct(actor).alias("actors"))
    order = W.partitionBy(key).orderBy(F.desc("actions"), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def yearly(df: DataFrame, key: str, ts: str, min_year: int = 2010) -> DataFrame:
    """Actions by key and year from min_year on; rows without a valid time have no year."""
    kind = dict(df.dtypes)[ts]
    t = moment(F.col(ts), kind)
    return df.where(t >= F.to_timestamp(F.lit(f"{min_year}-01-01"))).groupBy(key, year_of(F.col(ts), kind).alias("year")).agg(F.count("*").alias("actions"))


def yearly_pivot(df: DataFrame, key: str, ts: str, keys: Sequence[str], min_year: int = 2010) -> DataFrame:
    """One row a year, one column for each of keys, 0 where there was nothing."""
    return yearly(df, key, ts, min_year).groupBy("year").pivot(key, list(keys)).agg(F.sum("actions")).na.fill(0)


def productivity(df: DataFrame, key: str, actor: str) -> DataFrame:
    """Actors and mean actions of an actor, by key."""
    return df.groupBy(key, actor).agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("actors"), F.avg("n").alias("actions_per_actor"))


def frequency_histogram(df: DataFrame, key: str, actor: str) -> DataFrame:
    """How many actors of a key have how many actions."""
    return df.groupBy(key, actor).agg(F.count("*").alias("actions")).groupBy(key, "actions").agg(F.count("*").alias("actors"))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) for the bins that hold something, of equal width between the smallest and the largest value; the last holds both its ends.
    If all values are equal there is one bin. Nulls don't count."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return v.crossJoin(F.broadcast(span)).groupBy(b.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def lorenz(df: DataFrame, key: str, actor: str) -> DataFrame:
    """Of each key's actors, from the busiest on: the share of actors so far and of their actions, in percent."""
    counts = df.groupBy(key, actor).agg(F.count("*").alias("actions"))
    order, whole = W.partitionBy(key).orderBy(F.desc("actions"), actor), W.partitionBy(key)
    share = lambda x, y: F.round(x * F.lit(100.0) / y, 6)
    return counts.select(
        key, actor, "actions",
        share(F.row_number().over(order), F.count("*").over(whole)).alias("actors_pct"),
        share(F.sum("actions").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), F.sum("actions").over(whole)).alias("actions_pct"),
    )


def first_seen(df: DataFrame, actor: str, ts: str, tiebreak: str) -> DataFrame:
    """All rows, with is_new: whether it is the actor's first."""
    return df.withColumn("is_new", F.row_number().over(W.partitionBy(actor).orderBy(ts, tiebreak)) == 1)


def distinct_errors(df: DataFrame, key: str, item: str, actor: str, least: int = 50, top: int = 100) -> DataFrame:
    """The `top` items of most distinct actors (`least` at the least), with HyperLogLog counts at two accuracies and their signed errors in percent."""
    x = df.select(key, item, actor).distinct()  # beside an exact count Spark would build both sketches for every actor
    x = x.groupBy(key, item).agg(F.count(actor).alias("exact"), F.approx_count_distinct(actor, 0.05).alias("hll_05"), F.approx_count_distinct(actor, 0.1).alias("hll_10")).where(F.col("exact") >= least)
    e = F.col("exact")
    return x.withColumn("error_05", signed_error(F.col("hll_05"), e)).withColumn("error_10", signed_error(F.col("hll_10"), e)).orderBy(F.desc("exact"), key, item).limit(top)


def error_summary(df: DataFrame, estimate: str, exact: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and largest absolute error in percent, and the mean absolute error, by some columns."""
    pct = F.abs(signed_error(F.col(estimate), F.col(exact)))
    return df.groupBy(*by).agg(F.avg(pct).alias("mape"), F.median(pct).alias("median_error"), F.max(pct).alias("max_error"), F.avg(F.abs(F.col(estimate) - F.col(exact))).alias("mae"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares: y = slope * x + intercept."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def nearest_ranks(df: DataFrame, equal: dict[str, object], k: int, rank: str = "rank") -> DataFrame:
    """The k rows of the smallest ranks among those with the given values."""
    for c, v in equal.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.orderBy(rank).limit(k)


def storage_ratio(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Bytes of the files in two places, and how many times smaller the second is. Contents aren't read."""
    size = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("length").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"))
    return size(before).withColumnRenamed("n", "before").crossJoin(size(after).withColumnRenamed("n", "after")).withColumn("ratio", F.try_divide(F.col("before"), F.col("after")))
