"""Windowed counts of an event feed, for streams and batches alike, and trending items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import flag


def with_watermark(df: DataFrame, ts: str, late: str = "2 hours") -> DataFrame:
    """The same rows with `ts` as a timestamp and, on a stream, a watermark; a batch needs none."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def windowed_stats(df: DataFrame, ts: str, key: str, actor: str, bot: str | None = None, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window, key, actions, actors_hll, bot_actions) of tumbling windows, or sliding ones. Exact distinct counts don't work on
    streams, so actors are counted by HyperLogLog."""
    x = with_watermark(df, ts, late)
    bots = F.sum(flag(F.col(bot))) if bot else F.sum(F.lit(0))
    return x.groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("actions"), F.approx_count_distinct(actor).alias("actors_hll"), bots.alias("bot_actions"))


def windowed_counts(df: DataFrame, ts: str, key: str, item: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, item, actions)."""
    return with_watermark(df, ts, late).groupBy(F.window(ts, window), key, item).agg(F.count("*").alias("actions"))


def top_k(counts: DataFrame, key: str, item: str, k: int = 20) -> DataFrame:
    """The k items with the most actions in each window and key, with their ranks; ties by item. Rows whose key or item is null
    don't rank. For batches, and for the batches that foreachBatch sees."""
    order = W.partitionBy("window", key).orderBy(F.desc("actions"), item)
    return counts.dropna(subset=[key, item]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def new_items(df: DataFrame, ts: str, item: str, late: str = "2 hours") -> DataFrame:
    """The first row of each item within the watermark, on a stream; of each item, in a batch."""
    x = with_watermark(df, ts, late)
    if df.isStreaming:
        return x.dropDuplicatesWithinWatermark([item])
    return x.withColumn("_n", F.row_number().over(W.partitionBy(item).orderBy(ts))).where("_n = 1").drop("_n")


def to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends each window once, when the watermark has passed its end. once: takes what is there, then ends."""
    w = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def to_console(df: DataFrame, checkpoint: str) -> StreamingQuery:
    """For watching: changed windows only, so that state stays bounded by the watermark."""
    return df.writeStream.format("console").outputMode("update").option("truncate", "false").option("checkpointLocation", checkpoint).start()


def trending(counts: DataFrame, key: str, item: str, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 20, once: bool = False) -> StreamingQuery:
    """Ranks finished windows of a stream of counts as they come; sink gets each ranked batch and its number, the same number again if a
    batch is repeated."""
    w = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(top_k(df, key, item, k), n))
    return (w.trigger(availableNow=True) if once else w).start()


def run_all(spark, *queries: StreamingQuery) -> None:
    """Waits until one of the queries ends, and stops the others then, so that no failure goes unnoticed."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries:
            q.stop()
    for q in queries:
        if q.exception():
            raise q.exception()
