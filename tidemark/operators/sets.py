"""Sets in long form: one row for each (set, item). No set is ever gathered in one row unless that is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def members(df: DataFrame, keys: Sequence[str] | str, item: str) -> DataFrame:
    """Distinct (keys..., item); null items are no members."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.col(item).alias("item")).where("item is not null").distinct()


def gathered(long: DataFrame, keys: Sequence[str] | str, least: int = 0) -> DataFrame:
    """One row a set: its sorted items and their number; sets of fewer items are left out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return long.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"), F.count_distinct("item").alias("n")).where(F.col("n") >= least)


def at_least(long: DataFrame, keys: Sequence[str] | str, least: int) -> DataFrame:
    """The rows of the sets that have `least` items or more."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return long.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def united(long: DataFrame) -> DataFrame:
    """The items of all sets."""
    return long.select("item").distinct()


def absent(long: DataFrame, n: int) -> DataFrame:
    """n whole numbers above every item: surely in no set."""
    top = long.agg(F.coalesce(F.max("item"), F.lit(0)).alias("top"))
    return top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + n)).alias("item"))


def perturbed(long: DataFrame, key: str, levels: Sequence[float] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """(origin, level, item): for each set and level, the set without that share of its items and with as many new ones, which are above every item of any set. Which go follows from the items alone."""
    spark = long.sparkSession
    share = spark.createDataFrame([(float(x),) for x in levels], "level double")
    x = long.select(F.col(key).alias("origin"), "item")
    m, by, bits = F.pmod("item", F.lit(4294967296)), F.lit(2654435761), F.lit(65536)
    mixed = F.pmod(F.pmod(F.shiftright(m, 16) * by, bits) * bits + m.bitwiseAND(F.lit(65535)) * by, F.lit(4294967296))  # in halves: nothing overflows
    order = W.partitionBy("origin").orderBy(mixed, "item")
    ranked = x.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(share))
    sizes = x.groupBy("origin").agg(F.count("*").alias("n")).crossJoin(F.broadcast(share)).withColumn("d", F.floor(F.col("n") * F.col("level")))
    rest = ranked.join(sizes, ["origin", "level"]).where("r > d").select("origin", "level", "item")
    top = x.agg(F.max("item").alias("top"))
    new = sizes.where("d > 0").crossJoin(F.broadcast(top)).select("origin", "level", F.explode(F.sequence(F.col("top") + 1, F.col("top") + F.col("d"))).alias("item"))
    return rest.unionByName(new)
