"""Bloom filters and Flajolet-Martin sketches as relations: bits and registers are rows, so they build, merge and probe
by aggregation and joins, and nothing has to fit one task. Flajolet-Martin registers are made and merged as one array a set. Items are hashed by the universal family, which takes whole numbers, or, with mmh3,
by MurmurHash3 of their text with seeds from 0 on, which takes any items and gives the reference's very bits and registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import absolute_error
from ..functions.hashing import PRIME, by_length, family_table, murmur3_seeds, murmurs, universal, universals

SIZES, HASHES = (100_000, 500_000, 1_000_000, 5_000_000), (3, 5, 7, 10)
FM_HASHES = (16, 32, 64, 128, 256)
PHI = 0.77351


def _hashed(items: DataFrame, n: int, mmh3: bool) -> DataFrame:
    """(i, items' columns, hash): each item by each of n functions."""
    if mmh3:
        return items.select(*items.columns, F.posexplode(murmurs(F.col("item"), n)).alias("i", "hash")).select("i", *items.columns, "hash")
    return items.crossJoin(F.broadcast(family_table(items.sparkSession, n))).select("i", *items.columns, universal(F.col("item")).alias("hash"))


# --- Bloom ------------------------------------------------------------------------------------------------------


def _places(items: DataFrame, sizes: Sequence[int], k: int, mmh3: bool = False) -> DataFrame:
    """(m, i, item, place): where the i-th function puts an item in a filter of m bits."""
    spark = items.sparkSession
    m = F.broadcast(spark.createDataFrame([(int(x),) for x in sizes], "m long"))
    return _hashed(items, k, mmh3).crossJoin(m).select("m", "i", *items.columns, F.pmod("hash", F.col("m")).alias("place"))


def bloom_bits(items: DataFrame, m: int, k: int, mmh3: bool = False) -> DataFrame:
    """The set bits of the filter that holds `item` of all rows; the union of two such tables is the union's filter."""
    return _places(items.select("item").where("item is not null"), [m], k, mmh3).select("place").distinct()


def bloom_contains(bits: DataFrame, probes: DataFrame, m: int, k: int, mmh3: bool = False) -> DataFrame:
    """The distinct items of probes with contained: whether all their bits are set. Without bits nothing is contained."""
    p = _places(probes.select("item").where("item is not null").distinct(), [m], k, mmh3).select("item", "place").distinct()
    hit = p.join(bits.withColumn("set", F.lit(True)), "place", "left")
    return hit.groupBy("item").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("contained"))


def bloom_expected(k: Column, adds: Column, m: Column) -> Column:
    """The expected share of false positives; 0 for an empty filter."""
    return F.when(adds == 0, 0.0).otherwise(F.pow(1 - F.exp(-k * adds / m), k))


def bloom_memory(m: Column) -> Column:
    return F.ceil(m / 8)


def bloom_grid(known: DataFrame, probes: DataFrame, sizes: Sequence[int] = SIZES, hashes: Sequence[int] = HASHES, mmh3: bool = False) -> DataFrame:
    """For each size and number of functions the expected share of false positives, and the share of probes, none of which may be known, that were found. One job: filters of fewer
    functions are part of those of more."""
    spark, top = known.sparkSession, max(hashes)
    known, probes = (x.select("item").where("item is not null").distinct() for x in (known, probes))
    bits = _places(known, sizes, top, mmh3).groupBy("m", "place").agg(F.min("i").alias("first"))  # set in filters of more functions than that
    ks = F.broadcast(spark.createDataFrame([(int(k),) for k in hashes], "k int"))
    hit = _places(probes, sizes, top, mmh3).join(bits, ["m", "place"], "left").crossJoin(ks).where("i < k")
    found = hit.groupBy("m", "k", "item").agg(F.max(F.coalesce("first", F.lit(top))).alias("worst"))
    rates = found.groupBy("m", "k").agg(F.count("*").alias("probes"), F.count_if(F.col("worst") < F.col("k")).alias("found"))
    x = rates.crossJoin(F.broadcast(known.agg(F.count("*").alias("adds"))))
    return x.select("m", "k", "adds", bloom_expected(F.col("k"), F.col("adds"), F.col("m")).alias("expected"), (F.col("found") / F.col("probes")).alias("measured"), bloom_memory(F.col("m")).alias("memory_bytes"))


def bloom_stream(df: DataFrame, item: str, order: str, m: int, k: int, mmh3: bool = False) -> DataFrame:
    """One row: what a filter that takes in a stream item by item would have answered, against the truth. An item counts as seen if
    all its bits were set by rows before it. order is a column without ties."""
    x = df.select(F.col(item).alias("item"), F.col(order).alias("at")).where("item is not null")
    firsts = x.groupBy("item").agg(F.min("at").alias("first_at"))
    places = _places(firsts, [m], k, mmh3).select("item", "first_at", "place").distinct()
    bits = places.groupBy("place").agg(F.min("first_at").alias("set_at"))
    full = places.join(bits, "place").groupBy("item").agg(F.max("set_at").alias("all_set_at"))
    seen = x.join(firsts, "item").join(full, "item").select((F.col("first_at") < F.col("at")).alias("truth"), (F.col("all_set_at") < F.col("at")).alias("says"))
    s = seen.agg(F.count("*").alias("rows"), F.count_if(~F.col("truth")).alias("new"), F.count_if(~F.col("truth") & F.col("says")).alias("false_positives"), F.count_if(F.col("truth") & ~F.col("says")).alias("false_negatives"))
    return s.withColumn("false_positive_rate", F.coalesce(F.try_divide("false_positives", "new"), F.lit(0.0)))


# --- Flajolet-Martin --------------------------------------------------------------------------------------------


def _tops(items: pa.Array, sets: np.ndarray, count: int, n: int, mmh3: bool) -> np.ndarray:
    """(count, n): for each set and function the most trailing zeros among the hashes of its items. sets: of each item its set's number, ascending."""
    if mmh3:
        seeds = np.arange(n)
        parts = [(at, m, lambda x: murmur3_seeds(x, seeds)) for at, m in by_length([x.encode() for x in items.to_pylist()])]
    else:
        parts = [(np.arange(len(items)), items.to_numpy(zero_copy_only=False), universals(n))]
    low = np.full((count, n), -1, np.int32 if mmh3 else np.int64).view(np.uint32 if mmh3 else np.uint64)
    for at, values, hashes in parts:
        for k in range(0, len(at), 128):  # small enough for the processor's cache
            z, of = hashes(values[k : k + 128]), sets[at[k : k + 128]]
            z |= -z  # ones down to the lowest one; the trailing zeros stay
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for x, y in zip(edges, edges[1:]):
                low[of[x]] &= np.bitwise_and.reduce(z[x:y], axis=0)
    return np.minimum(low.itemsize * 8 - np.bitwise_count(low), 32)


def _combined(t: pa.Table, keys: Sequence[str], n: int, mmh3: bool, least: int, last: bool) -> pa.Table:
    """Rows (keys..., item, registers) of which those of equal keys follow each other, with one row of registers for those that have registers or `least` items.
    Other rows stay; in the last pass these are of sets without items, and one of each does."""
    t = t.combine_chunks()
    new = np.zeros(len(t), bool)
    new[0] = True
    for k in keys:
        codes = t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    of, count = np.cumsum(new) - 1, int(new.sum())
    there, made = (t[k].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for k in ("item", "registers"))
    done = np.bincount(of[there], minlength=count) >= least
    done[of[made]] = True
    at, now = np.cumsum(done) - 1, there & done[of]
    r = _tops(t["item"].filter(pa.array(now)).combine_chunks(), at[of[now]], int(done.sum()), n, mmh3)
    for k, x in zip(at[of[made]].tolist(), t["registers"].drop_null().to_pylist()):
        np.maximum(r[k], np.frombuffer(x, np.uint8), out=r[k])
    kept = new if last else new | ~done[of]
    wide, mask = done[of[kept]], pa.array(done[of[kept]])
    ends = pa.array(np.append(0, np.cumsum(wide * n)), pa.int32())
    registers = pa.Array.from_buffers(pa.binary(), len(wide), [pa.array(wide).buffers()[1], ends.buffers()[1], pa.py_buffer(r.tobytes())])
    t = t.filter(pa.array(kept))
    item = pc.if_else(mask, pa.scalar(None, t.schema.field("item").type), t["item"])
    return t.select(keys).append_column("item", item).append_column("registers", registers)


def _means(registers: np.ndarray, hashes: Sequence[int]) -> np.ndarray:
    """(sets, hashes): what the estimates are made of, see fm_estimates."""
    full = registers.shape[1] // 8 * 8
    s = np.sort(registers[:, :full].reshape(len(registers), -1, 8), axis=2)
    medians = (s[:, :, 3] + s[:, :, 4]) / 2
    return np.stack([registers[:, :k].mean(axis=1) if k <= 8 else medians[:, : k // 8].mean(axis=1) for k in hashes], axis=1)


def _sketching(keys: Sequence[str], n: int, mmh3: bool, last: bool, hashes: Sequence[int] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Combines the rows of a partition that is sorted by keys, of each batch by itself, or, in the last pass, of all, which are complete then: registers
    are returned, or, for numbers of functions, means."""

    def finished(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x = t["registers"].combine_chunks()
        values = np.frombuffer(b"".join(x.drop_null().to_pylist()), np.uint8).reshape(-1, n)
        values = values.view(np.int8) if hashes is None else _means(values, hashes)
        ends = np.append(0, np.cumsum(x.is_valid().to_numpy(zero_copy_only=False) * values.shape[1]))
        x = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()), mask=x.is_null())
        return iter(t.select(keys).append_column("values", x).combine_chunks().to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the set that may go on in the next batch
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                x = _combined(t if held is None else pa.concat_tables([held.cast(t.schema), t]), keys, n, mmh3, 1 if last else max(1, n // 8), last)
                if last:
                    held, x = x.slice(len(x) - 1), x.slice(0, len(x) - 1)
                    yield from finished(x) if len(x) else ()
                else:
                    yield from x.combine_chunks().to_batches()
        if held is not None:
            yield from finished(held)

    return run


def _sketched(long: DataFrame, keys: Sequence[str], n: int, mmh3: bool, hashes: Sequence[int] | None = None) -> DataFrame:
    """(keys..., values): the n registers of each set as an array, or, for numbers of functions, the means that make the estimates. Items are hashed n-fold
    in Arrow batches where they are; a set's registers, or its items if they are few, go to one task. So no more leaves a task than came, and large sets
    are spread over tasks."""
    x = long.where("item is not null") if mmh3 else long
    item = F.col("item").cast("string") if mmh3 else F.pmod("item", F.lit(PRIME)).bitwiseAND(F.lit(-1))
    names = [f"_{i}" for i in range(len(keys))]
    x = x.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], item.alias("item"), F.lit(None).cast("binary").alias("registers"))
    own = [T.StructField(a, x.schema[a].dataType) for a in names]
    partial = T.StructType([*own, T.StructField("item", x.schema["item"].dataType), T.StructField("registers", T.BinaryType())])
    final = T.StructType([*own, T.StructField("values", T.ArrayType(T.ByteType() if hashes is None else T.DoubleType()))])
    ordered = lambda y: y.sortWithinPartitions(*names) if names else y
    x = ordered(x).mapInArrow(_sketching(names, n, mmh3, False), partial)
    x = ordered(x.repartition(*names) if names else x.repartition(1)).mapInArrow(_sketching(names, n, mmh3, True, hashes), final)
    return x.toDF(*keys, "values")


def fm_registers(long: DataFrame, keys: Sequence[str], n: int = 256, mmh3: bool = False) -> DataFrame:
    """(keys..., i, r): for each of n functions the most trailing zeros among an item set's hashes."""
    r = F.coalesce("values", F.array_repeat(F.lit(None).cast("tinyint"), n))  # a set of nulls has them without values
    return _sketched(long, keys, n, mmh3).select(*keys, F.posexplode(r).alias("i", "r")).withColumn("r", F.col("r").cast("int"))


def fm_merged(registers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The registers of unions of sets: the maxima."""
    return registers.groupBy(*keys, "i").agg(F.max("r").alias("r"))


def _estimate(mean: Column) -> Column:
    return F.floor(F.pow(F.lit(2.0), mean) / PHI).cast("long")


def fm_estimates(registers: DataFrame, keys: Sequence[str], hashes: Sequence[int] = FM_HASHES) -> DataFrame:
    """(keys..., hashes, estimate). The first functions of each number count: up to 8 by the mean of their registers; more by the mean of the
    medians of groups of 8, those that fill no group being ignored. The estimator is biased."""
    ks = F.broadcast(registers.sparkSession.createDataFrame([(int(k),) for k in hashes], "hashes int"))
    x = registers.crossJoin(ks).where((F.col("i") < F.col("hashes")) & ((F.col("hashes") <= 8) | (F.col("i") < F.floor(F.col("hashes") / 8) * 8)))
    g = F.when(F.col("hashes") <= 8, F.col("i")).otherwise(F.floor(F.col("i") / 8))
    medians = x.groupBy(*keys, "hashes", g.alias("g")).agg(F.median("r").alias("m"))
    return medians.groupBy(*keys, "hashes").agg(_estimate(F.avg("m")).alias("estimate"))


def fm_evaluation(long: DataFrame, keys: Sequence[str], hashes: Sequence[int] = FM_HASHES, mmh3: bool = False) -> DataFrame:
    """Each set's estimate beside the exact count, for each number of functions, as fm_estimates gives it; registers are made once and leave their
    task as means. Sets with a null key have no row."""
    for k in keys:
        long = long.where(F.col(k).isNotNull())  # the join infers it for one side only, and the sides would share no exchange
    n = long.groupBy(*keys).agg(F.count_distinct("item").alias("exact"))
    ks = sorted({int(k) for k in hashes if k > 0})
    e = _sketched(long, keys, max(ks), mmh3, ks).join(n, list(keys))
    means = F.coalesce("values", F.array_repeat(F.lit(None).cast("double"), len(ks)))
    e = e.select(*keys, "exact", F.posexplode(means).alias("at", "mean")).withColumn("hashes", F.array(*map(F.lit, ks))[F.col("at")])
    return e.select(*keys, "hashes", _estimate(F.col("mean")).alias("estimate"), "exact").withColumn("error_pct", absolute_error(F.col("estimate"), F.col("exact")))


def fm_summary(evaluation: DataFrame) -> DataFrame:
    return evaluation.groupBy("hashes").agg(F.avg("error_pct").alias("mape"), F.max("error_pct").alias("max_error"), (F.col("hashes") * 4).alias("memory_bytes"))


def empty_fm_estimate(spark: SparkSession) -> DataFrame:
    """What a sketch without items answers: 1."""
    return spark.range(1).select(F.floor(F.lit(1.0) / PHI).cast("long").alias("estimate"))
