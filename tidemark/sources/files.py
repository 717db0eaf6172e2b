"""Files: XML dumps and their download, Parquet in and out."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import moment

_PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("revision", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("parentid", T.LongType()), T.StructField("timestamp", T.StringType()),
        T.StructField("contributor", T.StructType([T.StructField("username", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ip", T.StringType())])),
        T.StructField("comment", T.StringType()), T.StructField("text", T.StructType([T.StructField("_bytes", T.LongType()), T.StructField("_VALUE", T.StringType())])),
    ]))),
])


def xml_dump(spark: SparkSession, path: str | list[str], wiki: str, namespace: int = 0, registered: bool = True) -> DataFrame:
    """The revisions in XML dumps, plain or compressed, one row each, with the columns of schema.REVISIONS. Pages of other namespaces, or of
    none, are left out; so are, with registered, revisions without the id of a registered editor. Missing numbers are 0, missing texts empty, a missing or malformed time is null. A compressed
    file is read by one task; repartition what comes out before heavy work."""
    page = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path).where(F.col("ns") == namespace)
    r = page.select("title", "ns", F.col("id").alias("page"), F.explode("revision").alias("r"))
    c = F.col("r.contributor")
    named = c["username"].isNotNull()
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    out = r.select(
        F.lit(wiki).alias("wiki"), F.col("page").alias("page_id"), F.col("title").alias("page_title"), F.col("ns").alias("page_namespace"), F.col("r.id").alias("revision_id"), zero(F.col("r.parentid")).alias("parent_id"),
        moment(F.col("r.timestamp")).alias("timestamp"), zero(F.when(named, c["id"])).alias("contributor_id"), F.coalesce(F.when(named, c["username"]).otherwise(c["ip"]), F.lit("")).alias("contributor_name"),
        (~F.coalesce(named, F.lit(False))).alias("is_anonymous"), F.coalesce("r.comment", F.lit("")).alias("comment"), zero(F.col("r.text._bytes")).alias("text_bytes"),
    )
    return out.where("contributor_id <> 0") if registered else out


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A folder of Parquet; an empty table of `schema` if there is nothing at the path and a schema is given."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if schema is not None and not p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def to_parquet(df: DataFrame, path: str, by: Sequence[str] = (), files: int | None = None, compression: str = "snappy") -> None:
    """Replaces what is at the path. by: columns that become folders; files: at most so many (a single task writes each)."""
    df = df.coalesce(files) if files else df
    df.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)


# --- download ---------------------------------------------------------------------------------------------------


def _head(url: str) -> int | None:
    """The size of what is at a URL; None if nothing is."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
            return int(r.headers.get("Content-Length") or 0)
    except urllib.error.HTTPError:
        return None


def available_parts(base: str, wiki: str, date: str, most: int = 29, head: Callable[[str], int | None] = _head) -> list[str]:
    """The URLs of a dump's numbered parts up to the first that is missing; of the dump in one file if there are none."""
    stem = f"{base}/{wiki}/{date}/{wiki}-{date}-stub-meta-history"
    parts = []
    for i in range(1, most + 1):
        if head(url := f"{stem}{i}.xml.gz") is None:
            break
        parts.append(url)
    return parts or [url for url in [f"{stem}.xml.gz"] if head(url) is not None]


def download(url: str, to: str, chunk: int = 1 << 20, head: Callable[[str], int | None] = _head, opened: Callable = urllib.request.urlopen) -> bool:
    """Fetches a file unless it is there in full size already; False then. It appears under its name only when complete."""
    size = head(url)
    if size is not None and os.path.exists(to) and os.path.getsize(to) == size:
        return False
    with opened(url) as r, open(f"{to}.part", "wb") as f:
        while data := r.read(chunk):
            f.write(data)
    os.replace(f"{to}.part", to)
    return True
