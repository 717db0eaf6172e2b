"""Edge cases of the operators: empty tables, nulls, ties, and known values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import activity_bucket, moment, signed_error, trailing_zeros, window_label
from tidemark.functions.hashing import LARGEST, PRIME, family, murmur, murmur3, small, universal
from tidemark.operators import activity as A
from tidemark.operators import privacy as P
from tidemark.operators import sets as S
from tidemark.operators import similarity as M
from tidemark.operators import sketches as K
from tidemark.schema import Settings

LOG = "key string, item string, actor long, ts string, value double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_family_and_murmur(spark):
    assert family(3)[0] == (0, 2746317214, 1181241943) and family(3) == family(5)[:3]
    assert murmur3([b"foo", b"", b"hello, world"], 0).tolist()[:2] == [-156908512, 0]
    df = spark.createDataFrame([("foo",), (None,)], "x string")
    assert [r[0] for r in df.select(murmur(F.col("x"))).collect()] == [156908512, None]


def test_universal_at_the_ends(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, LARGEST, -5)], "x long").crossJoin(spark.createDataFrame([(PRIME - 1, PRIME - 1)], "a long, b long"))
    for x, h in df.select("x", universal(F.col("x"))).collect():
        assert h == ((PRIME - 1) * x + PRIME - 1) % PRIME
    assert 0 <= df.select(small(F.lit("any text"))).first()[0] <= LARGEST


def test_any_64_bit_item(spark):
    """The functions' values are those of whole numbers without bounds, whatever the item."""
    items = [0, LARGEST, PRIME, 3_000_000_000, -3_000_000_000, 2**62 + 5, 2**63 - 1, -(2**63)]
    f = family(5) + [(5, PRIME - 1, PRIME - 1)]
    df = spark.createDataFrame([(x,) for x in items], "item long")
    got = {(r["i"], r["item"]): r["h"] for r in df.crossJoin(spark.createDataFrame(f, "i int, a long, b long")).select("i", "item", universal(F.col("item")).alias("h")).collect()}
    assert got == {(i, x): (a * x + b) % PRIME for i, a, b in f for x in items}
    ids = list(range(3_000_000_000, 3_000_000_010)) + [2**62, -(2**62)]
    long = spark.createDataFrame([("s", x) for x in ids], "key string, item long")
    gone = sorted(ids, key=lambda x: (x * 2654435761 % 2**32, x))[:6]
    out = {r["item"] for r in S.perturbed(long, "key", [0.5]).collect()}
    assert out == set(ids) - set(gone) | {2**62 + i for i in range(1, 7)}


def test_distinct_errors(spark):
    df = spark.createDataFrame([("k", "i", x % 60) for x in range(180)] + [("k", "i", None), ("k", "few", 1)], "k string, i string, a long")
    (r,) = A.distinct_errors(df, "k", "i", "a").collect()
    assert (r["i"], r["exact"]) == ("i", 60) and abs(r["hll_05"] - 60) <= 9 and r["error_05"] == pytest.approx(100 * (r["hll_05"] - 60) / 60)


def test_scalars(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 10, 50, 200, None)], "n int")
    assert [r[0] for r in df.select(activity_bucket(F.col("n"))).collect()] == ["2_low", "1_single", "2_low", "3_medium", "4_high", "5_power", "5_power"]
    assert [r[0] for r in spark.createDataFrame([(0,), (8,), (7,), (1 << 31,)], "h long").select(trailing_zeros(F.col("h"))).collect()] == [32, 3, 0, 31]
    t = spark.createDataFrame([("",), ("nonsense",), ("2010-12-31T23:59:59Z",)], "t string").select(F.year(moment(F.col("t")))).collect()
    assert [r[0] for r in t] == [None, None, 2010]
    assert spark.range(1).select(signed_error(F.lit(1), F.lit(0))).first()[0] is None
    w = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5, 30),)], "t timestamp").select(window_label(F.window("t", "1 hour"))).first()[0]
    assert w == "2024-01-01 05:00 → 06:00"


def test_empty_tables(spark):
    e = spark.createDataFrame([], LOG)
    for df in (A.activity_stats(e, "key", "actor", "value"), A.top_items(e, "key", "item", "actor"), A.yearly(e, "key", "ts"), A.lorenz(e, "key", "actor"), A.equal_width_histogram(e, "value"), A.distinct_errors(e, "key", "item", "actor"), P.groups(e, "key", "actor", "ts")):
        assert df.count() == 0
    assert rows(P.statistics(P.groups(e, "key", "actor", "ts"))) == [(k, 0, 0, 0, 0.0, 0, 0, 0, 0.0) for k in (10, 2, 5)]
    long = S.members(e, "key", "actor")
    assert M.exact(long, "key").count() == M.signatures(long, "key").count() == 0
    assert [r["recall"] for r in M.band_sweep(long, "key").collect()] == [0.0] * 4
    assert K.bloom_contains(K.bloom_bits(long.select("item"), 100, 3), spark.createDataFrame([(1,)], "item long"), 100, 3).first()["contained"] is False
    assert K.empty_fm_estimate(spark).first()[0] == 1


def test_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, "x", 1, "", -1.0), ("k", "b", None, None, None), ("k", "a", 2, "2015-05-01", 0.0)], LOG)
    got = {r["key"]: r for r in A.activity_stats(df, "key", "actor", "value").collect()}
    assert got[None]["volume"] is None and got["k"]["actors"] == 1 and got["k"]["actions"] == 2
    assert [r["item"] for r in A.top_items(df.where("key = 'k'"), "key", "item", "actor", 1).collect()] == ["a"]
    assert rows(A.yearly(df, "key", "ts")) == [("k", 2015, 1)]
    assert S.members(df, "key", "actor").count() == 2


def test_histogram_of_equal_values(spark):
    assert rows(A.equal_width_histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v")) == [(0, 3.0, 3.0, 2)]


def test_k_anonymity(spark):
    df = spark.createDataFrame([("w", i, "2020-06-01") for i in range(3)], "key string, actor long, ts string")
    g = P.groups(df, "key", "actor", "ts")
    assert P.kept(g, 5).count() == 0 and P.kept(g, 2).count() == 1 and "actor" not in g.columns


def test_jaccard_and_minhash(spark):
    make = lambda **s: spark.createDataFrame([(k, x) for k, v in s.items() for x in v], "s string, item long")
    long = make(a=range(100), b=range(50, 150), c=range(100), d=range(1000, 1005))
    exact = {(r["a"], r["b"]): r["jaccard"] for r in M.exact(long, "s").collect()}
    g = M.signatures(long, "s")
    est = {(r["a"], r["b"]): r["estimate"] for r in M.estimated(g, g, "s", "s").collect()}
    assert exact["a", "c"] == est["a", "c"] == 1.0 and exact["a", "d"] == 0.0 and est["a", "d"] < 0.1
    assert abs(exact["a", "b"] - 1 / 3) < 1e-9 and abs(est["a", "b"] - 1 / 3) < 0.15
    assert g.where("s = 'a'").count() == 128
    assert ("a", "c") in {(r["a"], r["b"]) for r in M.candidates(g, "s", [(32, 4)]).collect()}
    m = {(r["a"], r["b"]): r["jaccard"] for r in M.matrix(M.exact(long, "s"), "jaccard").collect()}
    assert m["b", "a"] == m["a", "b"] and m["d", "d"] == 1.0 and len(m) == 16


def test_mllib_pairs_of_all_items(spark, monkeypatch):
    """Items of one set only are in the distance too, whatever the vocabulary's limit; here pyspark's default is forced below the items."""
    from pyspark.ml.feature import CountVectorizer

    init = CountVectorizer.__init__
    monkeypatch.setattr(CountVectorizer, "__init__", lambda self, **x: init(self, **{"vocabSize": 50} | x))
    make = lambda **s: spark.createDataFrame([(k, x) for k, v in s.items() for x in v], "s string, item long")
    long = make(a=range(100), b=range(50, 150), c=[*range(100), 5])
    got = {(r["a"], r["b"]): r["jaccard_distance"] for r in M.mllib_pairs(long, "s", 20).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "c"] == 0 and math.isclose(got["a", "b"], 2 / 3) and math.isclose(got["b", "c"], 2 / 3)
    at = M.numbered(long.select(F.col("item").cast("string")), 7).collect()
    assert sorted(r["at"] for r in at) == list(range(150)) and len({r["item"] for r in at}) == 150
    assert {r["v"].size for r in M.vectors(long, "s").collect()} == {150}


def test_precision_recall(spark):
    found = spark.createDataFrame([(1, 1, *p) for p in (("a", "b"), ("b", "c"), ("a", "c"))], "bands int, rows int, a string, b string")
    truth = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    r = M.precision_recall(found, truth, [(1, 1)]).first()
    assert abs(r["precision"] - 2 / 3) < 1e-9 and r["recall"] == 1.0


def test_bloom(spark):
    known = spark.range(1000).withColumnRenamed("id", "item")
    bits = K.bloom_bits(known, 100_000, 7)
    assert K.bloom_contains(bits, known, 100_000, 7).where("not contained").count() == 0
    fp = K.bloom_contains(bits, spark.range(1000, 11000).withColumnRenamed("id", "item"), 100_000, 7).where("contained").count()
    assert fp < 500
    mixed = lambda a, b: spark.range(a, b).select(small(F.col("id")).alias("item"))
    g = K.bloom_grid(mixed(0, 1000), mixed(1000, 3000), [800_000, 2000], [3]).collect()
    by = {r["m"]: r for r in g}
    assert by[800_000]["memory_bytes"] == 100_000 and by[800_000]["measured"] <= 0.01
    assert abs(by[2000]["measured"] - by[2000]["expected"]) < 0.1


def test_flajolet_martin(spark):
    part = lambda s, a, b: spark.range(a, b).select(F.lit(s).alias("s"), "id", small(F.col("id")).alias("item"))
    x = part("a", 0, 5000).unionByName(part("b", 3000, 8000))
    reg = K.fm_registers(x, ["s"], 64)
    merged = K.fm_estimates(K.fm_merged(reg, []), [], [64]).first()["estimate"]
    assert abs(merged - 8000) / 8000 < 0.75  # the estimator is biased upwards
    few = K.fm_estimates(K.fm_registers(x.where("id < 10"), ["s"], 64), ["s"], [64, 8, 12]).collect()
    assert all(r["estimate"] > 0 for r in few)
    regs = {r["i"]: r["r"] for r in reg.where("s = 'a'").collect()}
    want = int(2 ** (sum(regs[i] for i in range(8)) / 8) / 0.77351)
    assert K.fm_estimates(reg, ["s"], [8]).where("s = 'a'").first()["estimate"] == want


def test_murmur_sketches(spark):
    """The reference's bits and registers, of items that aren't whole numbers too."""
    assert murmur3([b"test", b"Hello, world!", b"aaaa"], 0x9747B28C).tolist() == [0x704B81DC, 0x24884CBA, 0x5A97808A]  # published values
    names = ["foo", "Ünï", "a b c", "", "17"]
    items = spark.createDataFrame([("s", x) for x in [*names, None]], "s string, item string")
    h = [[abs(int(murmur3([x.encode()], seed)[0])) for seed in range(16)] for x in names]
    bits = K.bloom_bits(items, 1000, 5, mmh3=True)
    assert {r["place"] for r in bits.collect()} == {v % 1000 for x in h for v in x[:5]}
    probes = spark.createDataFrame([(x,) for x in ["foo", "bar", ""]], "item string")
    assert rows(K.bloom_contains(bits, probes, 1000, 5, mmh3=True)) == [("", True), ("bar", False), ("foo", True)]
    tz = lambda v: 32 if v == 0 else (v & -v).bit_length() - 1
    assert rows(K.fm_registers(items, ["s"], 16, mmh3=True)) == sorted((("s", i, max(tz(x[i]) for x in h)) for i in range(16)), key=str)


def test_perturbed_sets(spark):
    long = spark.range(100).select(F.lit("s").alias("s"), F.col("id").alias("item"))
    p = S.perturbed(long, "s", [0.1, 0.5])
    assert p.groupBy("level").count().where("count <> 100").count() == 0
    assert p.where("level = 0.5 and item > 99").count() == 50


def test_detection_curve(spark):
    r = M.detection_curve(spark, [(16, 8)], 3).orderBy("similarity").collect()
    assert r[0]["detected"] == 0 and r[2]["detected"] == 1 and math.isclose(r[1]["detected"], 1 - (1 - 0.5**8) ** 16)


def test_settings():
    assert Settings.of({"top_k": 5, "bands": [[2, 3]]}).bands == ((2, 3),)
    with pytest.raises(ValueError):
        Settings.of({"nothing": 1})
