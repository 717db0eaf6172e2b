"""The live feed: server-sent events, JSON messages, and the connectors that bring them."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..schema import EVENTS


def decode(raw: DataFrame, value: str = "value", schema: StructType = EVENTS) -> DataFrame:
    """JSON messages as columns, with event_time. What can't be parsed gives nulls."""
    x = raw.select(F.from_json(F.col(value).cast("string"), schema).alias("d")).select("d.*")
    return x.withColumn("event_time", F.timestamp_seconds("timestamp")) if "timestamp" in schema.names else x


def wanted(events: DataFrame, wikis: Sequence[str], namespace: int = 0, kind: str = "edit") -> DataFrame:
    """Edits of some wikis in one namespace; nulls don't pass."""
    return events.where(F.col("wiki").isin(*wikis) & (F.col("namespace") == namespace) & (F.col("type") == kind))


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A stream of (value); needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def messages(lines: Iterable[str]) -> Iterator[tuple[str | None, str]]:
    """(last id, data) of server-sent events: lines of data gather until a blank line. Comments and other fields are passed over."""
    data, last = [], None
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                yield last, "\n".join(data)
            data = []
        elif not line.startswith(":"):
            name, _, v = line.partition(":")
            v = v.removeprefix(" ")
            if name == "data":
                data.append(v)
            elif name == "id":
                last = v


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.url, self.most = options["url"], int(options.get("batch", 1000))
        self.seconds = float(options.get("seconds", 5))

    def initialOffset(self) -> dict:
        return {"id": "", "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": start["id"]} if start["id"] else {})
        rows, last, until = [], start["id"], time.monotonic() + self.seconds
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=self.seconds) as r:
                for i, m in messages(x.decode("utf-8", "replace") for x in r):
                    last = i or last
                    rows.append((i, m))
                    if len(rows) >= self.most or time.monotonic() > until:
                        break
        except OSError:  # the feed is tried again with the next batch
            pass
        return iter(rows), {"id": last, "n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self.read(start)
        for k, row in enumerate(rows):
            if k < end["n"] - start["n"]:
                yield row


class ServerSentEvents(DataSource):
    """spark.readStream.format("sse").option("url", ...): rows (id, value). The feed resumes after the last id."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "id string, value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def counted(df: DataFrame, name: str = "feed") -> DataFrame:
    """The same rows, observed: a StreamingQueryListener gets the number of rows of each batch under `name`."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def progress(line: str) -> dict:
    """Counters as one JSON object: what the observed metrics of a query's progress hold."""
    return {k: dict(v) for k, v in json.loads(line).get("observedMetrics", {}).items()}


