"""Similarity of sets in long form (set, item): exact Jaccard, MinHash signatures, LSH banding, and how well they do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.columns import bands_label
from ..functions.hashing import PRIME, family_table, universal

CONFIGS = ((16, 8), (32, 4), (64, 2), (128, 1))


def pairs(long: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b, for all sets."""
    ids = long.select(key).distinct()
    a, b = (ids.select(F.col(key).alias(x)) for x in "ab")
    return a.join(b, F.col("a") < F.col("b"))


def exact(long: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """(a, b, common, total, jaccard) of all pairs, or of wanted ones; pairs without a common item have 0. Counting runs over
    common items, so that no set is held whole."""
    sizes = long.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    x = long.select(F.col(key).alias("a"), "item").join(long.select(F.col(key).alias("b"), "item"), "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    p = pairs(long, key) if wanted is None else wanted.select("a", "b")
    x = p.join(x, ["a", "b"], "left").join(sizes.toDF("a", "na"), "a", "left").join(sizes.toDF("b", "nb"), "b", "left").na.fill(0)
    total = F.col("na") + F.col("nb") - F.col("common")
    return x.select("a", "b", "common", total.alias("total"), F.coalesce(F.try_divide("common", total), F.lit(0.0)).alias("jaccard"))


def signatures(long: DataFrame, key: str | Sequence[str], n: int = 128, prime: int = PRIME) -> DataFrame:
    """(key, i, h): the smallest hash of each set by each of n functions. A set without items has no rows. The functions' table has n rows, so it
    is broadcast whatever the data's size; minima combine before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    f = F.broadcast(family_table(long.sparkSession, n, prime))
    return long.crossJoin(f).groupBy(*keys, "i").agg(F.min(universal(F.col("item"), prime)).alias("h"))


def estimated(left: DataFrame, right: DataFrame, a: str, b: str, n: int = 128, ordered: bool = True) -> DataFrame:
    """(a, b, estimate): the share of equal values of signatures, for pairs a < b (or all pairs)."""
    x = left.select(F.col(a).alias("a"), "i", F.col("h").alias("ha")).join(right.select(F.col(b).alias("b"), "i", F.col("h").alias("hb")), "i")
    if ordered:
        x = x.where("a < b")
    return x.groupBy("a", "b").agg((F.count_if(F.col("ha") == F.col("hb")) / F.lit(float(n))).alias("estimate"))


def banded(signed: DataFrame, key: str, configs: Sequence[tuple[int, int]] = CONFIGS) -> DataFrame:
    """(bands, rows, band, value, key): for each configuration the bands of each signature; value is what sets must share to be candidates, the rows
    themselves, so different rows never meet."""
    c = F.broadcast(signed.sparkSession.createDataFrame(list(configs), "bands int, rows int"))
    x = signed.crossJoin(c).where(F.col("i") < F.col("bands") * F.col("rows")).withColumn("band", F.floor(F.col("i") / F.col("rows")).cast("int"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda s: s["h"].cast("string"))
    return x.groupBy("bands", "rows", "band", key).agg(F.array_join(rows, ",").alias("value"))


def candidates(signed: DataFrame, key: str, configs: Sequence[tuple[int, int]] = CONFIGS) -> DataFrame:
    """(bands, rows, a, b): pairs a < b that share a band."""
    x = banded(signed, key, configs)
    on = ["bands", "rows", "band", "value"]
    return x.withColumnRenamed(key, "a").join(x.withColumnRenamed(key, "b"), on).where("a < b").select("bands", "rows", "a", "b").distinct()


def precision_recall(found: DataFrame, truth: DataFrame, configs: Sequence[tuple[int, int]] = CONFIGS) -> DataFrame:
    """For each configuration how many pairs were found, and the shares of them that are true and of the true ones that are
    found; 0 where there are none."""
    spark = found.sparkSession
    c = F.broadcast(spark.createDataFrame(list(configs), "bands int, rows int"))
    t = truth.select("a", "b").distinct().withColumn("true", F.lit(1))
    f = found.join(t, ["a", "b"], "left").groupBy("bands", "rows").agg(F.count("*").alias("found"), F.count("true").alias("right"))
    x = c.join(f, ["bands", "rows"], "left").na.fill(0).crossJoin(F.broadcast(t.agg(F.count("*").alias("true_pairs"))))
    share = lambda y: F.coalesce(F.try_divide("right", y), F.lit(0.0))
    return x.select("bands", "rows", bands_label(F.col("bands"), F.col("rows")).alias("label"), F.col("found").alias("candidates"), share("found").alias("precision"), share("true_pairs").alias("recall"))


def band_sweep(long: DataFrame, key: str, configs: Sequence[tuple[int, int]] = CONFIGS, threshold: float = 0.05) -> DataFrame:
    """Precision and recall of LSH for several configurations, against the pairs whose exact similarity is `threshold` or more."""
    n = max(b * r for b, r in configs)
    return precision_recall(candidates(signatures(long, key, n), key, configs), exact(long, key).where(F.col("jaccard") >= threshold), configs)


def matrix(scores: DataFrame, value: str) -> DataFrame:
    """(a, b, value) both ways, with 1 on the diagonal, from pairs a < b."""
    both = scores.select("a", "b", value).unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    ids = both.select("a").distinct()
    return both.unionByName(ids.select("a", F.col("a").alias("b"), F.lit(1.0).alias(value)))


def detection_curve(spark, configs: Sequence[tuple[int, int]] = CONFIGS, points: int = 200) -> DataFrame:
    """The chance that sets of a similarity become candidates."""
    s = spark.range(points).select((F.col("id") / (points - 1)).alias("similarity"))
    c = F.broadcast(spark.createDataFrame(list(configs), "bands int, rows int"))
    return s.crossJoin(c).withColumn("detected", 1 - F.pow(1 - F.pow("similarity", F.col("rows")), F.col("bands")))


def numbered(items: DataFrame, buckets: int = 1024) -> DataFrame:
    """(item, at): the distinct items with the numbers from 0 on, none left out, as the reference maps ids to indices. Items are ranked within
    buckets of their hashes and follow the buckets before; the numbers depend on the items only, and no item goes to the driver."""
    x = items.select("item").where("item is not null").distinct().withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    n = x.groupBy("bucket").agg(F.count("*").alias("n"))  # `buckets` rows at most
    before = n.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("item"))
    return x.withColumn("rank", rank).join(F.broadcast(before), "bucket").select("item", (F.col("before") + F.col("rank") - 1).cast("int").alias("at"))


def vectors(long: DataFrame, key: str) -> DataFrame:
    """(id, v): each set as a sparse vector with a place for every item of all sets. Sets without items have no rows. A vector is one value,
    as MLlib wants it."""
    from pyspark.ml.linalg import VectorUDT

    at = numbered(long)
    n = at.count()
    x = long.join(at, "item").groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set("at")).alias("indices"))
    v = F.struct(F.lit(0).alias("type"), F.lit(n).alias("size"), "indices", F.transform("indices", lambda _: F.lit(1.0)).alias("values"))
    return x.select("id", F.from_json(F.to_json(F.struct(v.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"].alias("v"))  # the JVM's way to a vector


def mllib_pairs(long: DataFrame, key: str, tables: int = 5, distance: float = 0.8) -> DataFrame:
    """(a, b, jaccard_distance) by MLlib's MinHashLSH with its own functions: pairs below a distance, found approximately; the distances are of
    all items."""
    from pyspark.ml.feature import MinHashLSH

    docs = vectors(long, key)
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=42).fit(docs)
    return model.approxSimilarityJoin(docs, docs, distance, "d").select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), F.col("d").alias("jaccard_distance")).where("a < b")
