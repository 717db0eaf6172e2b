"""Flajolet-Martin registers at size: how many rows the functions make, and the same registers however rows, batches and tasks fall."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import LARGEST, PRIME, family, murmur3
from tidemark.operators import sketches as K


def most_rows(df):
    """The rows out of the operator that returns most, of a run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("numOutputRows")
        return max([m.get().value() if m.isDefined() else 0, *map(walk, below)])

    return walk(plan)


def sets(spark, number=100, size=30, parts=3):
    x = spark.range(0, number * size, 1, parts)
    return x.select((F.col("id") % number).alias("s"), "id", (F.col("id") * 7919 + 13).alias("item"))


def tz(h):
    return 32 if h == 0 else (h & -h).bit_length() - 1


def registers(items, n, mmh3):
    hashes = (lambda x, i, a, b: abs(int(murmur3([str(x).encode()], i)[0]))) if mmh3 else (lambda x, i, a, b: (a * x + b) % PRIME)
    return [max(tz(hashes(x, *f)) for x in items) for f in family(n)]


def test_f1_summary_makes_no_row_per_item_and_function(spark):
    s = K.fm_summary(K.fm_evaluation(sets(spark), ["s"]))
    assert most_rows(s) <= 3000  # before, 3000 items x 256 functions


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_f1_registers_of_any_items_and_batches(spark, small_batches):
    """Items at the ends of 64 bits, one that hashes to 0, sets of one item and of several batches, spread over tasks; a null set."""
    r = random.Random(1)
    _, a, b = family(1)[0]
    zero = -b * pow(a, -1, PRIME) % PRIME
    by = {"ends": [0, LARGEST, PRIME, PRIME - 1, 2**32, 2**63 - 1, -(2**63), -5], "zero": [zero], "one": [6], "big": [r.randrange(-(2**63), 2**63) for _ in range(90)], None: [1, 2]}
    rows = [(k, x) for k, v in by.items() for x in v] + [("nulls", None), ("one", None)]
    r.shuffle(rows)
    long = spark.createDataFrame(rows, "s string, item long").repartition(3)
    want = {(k, i): x for k, v in by.items() for i, x in enumerate(registers(v, 32, False))} | {("nulls", i): None for i in range(32)}
    assert {(x["s"], x["i"]): x["r"] for x in K.fm_registers(long, ["s"], 32).collect()} == want and want["zero", 0] == 32
    whole = registers([x for v in by.values() for x in v], 32, False)
    assert [x["r"] for x in K.fm_registers(long, [], 32).orderBy("i").collect()] == whole
    assert K.fm_registers(long.where("false"), ["s"], 32).count() == K.fm_registers(long.where("false"), [], 32).count() == 0


def test_f1_evaluation_is_that_of_the_registers(spark, small_batches):
    x = sets(spark, 11, 23).withColumn("t", F.col("s") % 2).unionByName(spark.createDataFrame([(99, 0, None, 0)], "s long, id long, item long, t long"))
    ks = [3, 8, 12, 16, 64]
    want = K.fm_estimates(K.fm_registers(x, ["t", "s"], 64), ["t", "s"], ks)
    got = K.fm_evaluation(x, ["t", "s"], ks)
    assert got.columns == ["t", "s", "hashes", "estimate", "exact", "error_pct"] and got.count() == 12 * 5
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r["exact"], r["estimate"] is None, r["error_pct"] is None) for r in got.collect()} == {(23, False, False), (0, True, True)}


def test_f2_mmh3_makes_no_row_per_item_and_function(spark, small_batches):
    x = sets(spark, 40, 30).withColumn("item", F.concat(F.lit("é" * 3), F.expr("repeat('x', cast(item % 6 as int))"), F.col("item")))
    e = K.fm_evaluation(x, ["s"], mmh3=True)
    assert most_rows(e) <= 1200  # before, 1200 items x 256 functions
    by = {}
    for r in x.collect():
        by.setdefault(r["s"], []).append(r["item"])
    got = {(r["s"], r["i"]): r["r"] for r in K.fm_registers(x, ["s"], 24, mmh3=True).collect()}
    assert got == {(k, i): v for k, items in by.items() for i, v in enumerate(registers(items, 24, True))}


def test_f3_evaluation_makes_no_row_per_item_and_function(spark):
    assert most_rows(K.fm_evaluation(sets(spark), ["s"])) <= 3000  # before, 3000 items x 256 functions


def test_f4_merging_takes_a_row_per_set_and_function(spark):
    merged = K.fm_merged(K.fm_registers(sets(spark), ["s"], 64), [])
    assert most_rows(merged) <= 100 * 64  # before, 3000 items x 64 functions
    assert [r["r"] for r in merged.orderBy("i").collect()] == registers([r["item"] for r in sets(spark).collect()], 64, False)
