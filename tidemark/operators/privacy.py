"""Release of aggregates with k-anonymity: counts are generalised, small groups are suppressed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import activity_bucket, moment, year_of


def groups(df: DataFrame, key: str, actor: str, ts: str, min_year: int = 2010) -> DataFrame:
    """Distinct actors and records of each (key, year, bucket of activity). Identifiers don't come out."""
    kind = dict(df.dtypes)[ts]
    rows = df.where(moment(F.col(ts), kind) >= F.to_timestamp(F.lit(f"{min_year}-01-01")))
    each = rows.groupBy(key, year_of(F.col(ts), kind).alias("year"), actor).agg(F.count("*").alias("n"))
    return each.groupBy(key, "year", activity_bucket(F.col("n")).alias("bucket")).agg(F.count_distinct(actor).alias("actors"), F.count("*").alias("records"))


def judged(grouped: DataFrame, k_values: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """Each group for each k, with kept: whether it has k actors or more. One plan for all k."""
    ks = grouped.sparkSession.createDataFrame([(int(k),) for k in k_values], "k int")
    return grouped.crossJoin(F.broadcast(ks)).withColumn("kept", F.col("actors") >= F.col("k"))


def kept(grouped: DataFrame, k: int) -> DataFrame:
    return grouped.where(F.col("actors") >= k)


def suppressed(grouped: DataFrame, k: int) -> DataFrame:
    return grouped.where(F.col("actors") < k)


def statistics(grouped: DataFrame, k_values: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """What each k costs, in groups and actors. An actor counts once for each group. Without groups every k has a row, of zeros."""
    ks = grouped.sparkSession.createDataFrame([(int(k),) for k in k_values], "k int")
    sums = judged(grouped, k_values).groupBy("k").agg(
        F.count("*").alias("groups"), F.count_if("kept").alias("groups_kept"), F.sum("actors").alias("actors"),
        F.sum(F.when(F.col("kept"), F.col("actors")).otherwise(0)).alias("actors_kept"),
    )
    x = F.broadcast(ks).join(sums, "k", "left").na.fill(0)
    pct = lambda a, b: F.coalesce(F.round(F.try_divide((F.col(b) - F.col(a)) * F.lit(100.0), F.col(b)), 2), F.lit(0.0))
    return x.select(
        "k", "groups", "groups_kept", (F.col("groups") - F.col("groups_kept")).alias("groups_suppressed"), pct("groups_kept", "groups").alias("groups_suppressed_pct"),
        "actors", "actors_kept", (F.col("actors") - F.col("actors_kept")).alias("actors_suppressed"), pct("actors_kept", "actors").alias("actors_suppressed_pct"),
    )
