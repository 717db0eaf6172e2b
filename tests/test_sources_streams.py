import datetime
import gzip
import io
import json

from pyspark.sql import functions as F

from tidemark.schema import EVENTS, REVISIONS
from tidemark.sources import events as E
from tidemark.sources import files as X
from tidemark.streaming import windows as T

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>A</title><ns>0</ns><id>7</id>
<revision><id>1</id><timestamp>2020-01-02T03:04:05Z</timestamp><contributor><username>u</username><id>5</id></contributor><comment>c</comment><text bytes="12" /></revision>
<revision><id>2</id><parentid>1</parentid><timestamp></timestamp><contributor><username>v</username><id>6</id></contributor><text bytes="3" /></revision>
<revision><id>3</id><timestamp>2020-01-02T03:04:05Z</timestamp><contributor><ip>1.2.3.4</ip></contributor></revision>
<revision><id>4</id><timestamp>2020-01-02T03:04:05Z</timestamp></revision></page>
<page><title>T</title><ns>1</ns><id>8</id><revision><id>5</id><contributor><username>u</username><id>5</id></contributor></revision></page>
</mediawiki>"""


def test_xml_dump(spark, tmp_path):
    (tmp_path / "a.xml").write_text(DUMP)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(DUMP)
    for name in ("a.xml", "b.xml.gz"):
        df = X.xml_dump(spark, str(tmp_path / name), "xx")
        assert df.columns == REVISIONS.names
        r = {x["revision_id"]: x for x in df.collect()}
        assert set(r) == {1, 2}
        assert (r[1]["parent_id"], r[1]["text_bytes"], r[1]["contributor_name"], r[2]["comment"], r[2]["timestamp"]) == (0, 12, "u", "", None)
        every = {x["revision_id"]: x for x in X.xml_dump(spark, str(tmp_path / name), "xx", registered=False).collect()}
        assert every[3]["contributor_name"] == "1.2.3.4" and every[3]["is_anonymous"] and every[4]["contributor_name"] == ""


def test_parquet(spark, tmp_path):
    at = str(tmp_path / "out")
    assert X.parquet(spark, at, REVISIONS).count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    X.to_parquet(df, at, ["k"])
    X.to_parquet(df, at, ["k"])
    assert X.parquet(spark, at).count() == 2


def test_download(tmp_path):
    parts = X.available_parts("http://x", "enwiki", "20260201", head=lambda u: 5 if "history1" in u or "history2" in u else None)
    assert len(parts) == 2
    assert X.available_parts("http://x", "w", "1", head=lambda u: 5 if u.endswith("history.xml.gz") else None) == ["http://x/w/1/w-1-stub-meta-history.xml.gz"]
    to = str(tmp_path / "f")
    assert X.download("u", to, head=lambda u: 3, opened=lambda u: io.BytesIO(b"abc"))
    assert not X.download("u", to, head=lambda u: 3, opened=lambda u: io.BytesIO(b"abc"))


def test_messages():
    lines = [": hello\n", "id: 4\n", 'data: {"a":\n', "data: 1}\n", "\n", "event: x\n", "\n", "data:z\n", "\n", "data: unfinished\n"]
    assert list(E.messages(lines)) == [("4", '{"a":\n1}'), ("4", "z")]


def test_decode(spark):
    good = json.dumps({"wiki": "enwiki", "title": "T", "namespace": 0, "type": "edit", "timestamp": 60, "length": {"old": 1, "new": 2}})
    df = E.decode(spark.createDataFrame([(good,), ("{broken",)], "value string"))
    assert [c for c in df.columns if c != "event_time"] == EVENTS.names
    assert df.where("wiki is null").count() == 1
    r = E.wanted(df, ["enwiki"]).collect()
    assert len(r) == 1 and r[0]["event_time"] == datetime.datetime(1970, 1, 1, 0, 1) and r[0]["length"]["new"] == 2


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, key string, actor long, bot boolean, item string"
    files = [[(at(0, 5), "a", 1, True, "x"), (at(0, 50), "a", 2, None, "x")], [(at(1, 5), "a", 1, False, "y")], [(at(9), "z", 1, None, "s")], [(at(9), "z", 2, None, "s")], [(at(0, 30), "a", 3, True, "x")], [(at(9, 1), "z", 1, None, "s")]]
    src = tmp_path / "in"
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(str(src / f"{i}"))
    import os
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(files)):
        part = next(p for p in (src / str(i)).iterdir() if p.suffix == ".parquet")
        shutil.copy(part, flat / f"{i}.parquet")
        os.utime(flat / f"{i}.parquet", (1000 + i, 1000 + i))
    s = stream(spark, str(flat), schema)
    T.to_parquet(T.windowed_stats(s, "ts", "key", "actor", "bot"), str(tmp_path / "out"), str(tmp_path / "c1"), once=True).awaitTermination()
    got = {(r["window"]["start"].hour, r["key"]): (r["actions"], r["bot_actions"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "a"): (2, 1), (1, "a"): (1, 0)}
    ranked = []
    T.trending(T.windowed_counts(stream(spark, str(flat), schema), "ts", "key", "item"), "key", "item", lambda df, n: ranked.extend(df.collect()), str(tmp_path / "c2"), once=True).awaitTermination()
    assert {(r["window"]["start"].hour, r["item"], r["actions"], r["rank"]) for r in ranked} == {(0, "x", 2, 1), (1, "y", 1, 1)}


def test_new_items_in_a_batch(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 2)], "ts string, actor long").withColumn("ts", F.to_timestamp("ts"))
    assert T.new_items(df, "ts", "actor").count() == 2


def test_top_k_ties(spark):
    w = "named_struct('start', timestamp'2024-01-01', 'end', timestamp'2024-01-02')"
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 2), ("k", None, 9)], "key string, item string, actions long").withColumn("window", F.expr(w))
    assert [(r["item"], r["rank"]) for r in T.top_k(df, "key", "item", 1).collect()] == [("a", 1)]
