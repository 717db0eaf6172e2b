"""BPE, toxicity, decontamination, licences, sharding, WARC and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, license_scan, license_texts, sharding, toxicity, warc

from .test_dedup import DOCS, awkward, docs, prose, rows

ODD = ["", " ", "\n\n  x", "tabs\t\tand  spaces   ", "Ünï çödé 漢字かな 🙂🙂 <|endoftext|> don't we'll", "a" * 5000, "1234567890" * 80, " " * 900, "\r\n" * 50, "x y　z"]


# --- BPE ------------------------------------------------------------------------------------------------------


def test_joined_is_the_whole_encoding():
    enc, rng = bpe.encoding(), random.Random(1)
    for t in [*ODD, prose(rng, 300), "".join(rng.choice("ab \n.é'1") for _ in range(3000))]:
        chars = list(t)
        for _ in range(8):
            at = sorted(rng.sample(range(len(chars) + 1), min(len(chars), rng.randrange(6))))
            parts = ["".join(chars[a:b]) for a, b in zip([0, *at], [*at, len(chars)])]
            assert bpe.joined(enc, [enc.encode_ordinary(p) for p in parts]) == enc.encode_ordinary(t)


def test_cuts():
    rng = random.Random(2)
    a, b, shared = (prose(rng, 800).encode() for _ in range(3))
    chunks = []
    for x in (a + shared, b + shared):
        buf = np.frombuffer(x, np.uint8)
        at = bpe.cuts(buf)
        assert at[0] == 0 and at[-1] == len(x) and (np.diff(at) > 0).all()
        chunks.append(set(bpe.chunk_hashes(buf, at).tolist()))
    assert len(chunks[0] & chunks[1]) >= 5


def test_encoding(spark):
    rng, enc = random.Random(3), bpe.encoding()
    shared = prose(rng, 700)
    texts = [*ODD, None, shared, shared, "start " + shared, shared + " é end", prose(rng, 400) + shared + prose(rng, 400), shared[3:] * 3, prose(rng, 20000)]
    df = docs(spark, texts)
    got = bpe.encoded(df)
    out = {r["doc_id"]: r for r in got.collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        if t is None:
            assert r["ids"] is r["n_tokens"] is r["round_trip"] is None
        else:
            assert r["ids"] == enc.encode_ordinary(t) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    back = dict(rows(got.select("doc_id", bpe.decoded()(F.col("ids")))))
    assert back == dict(enumerate(texts))
    a = bpe.encoded(awkward(spark))
    assert a.count() == 8 and a.where("not round_trip").count() == 0 and bpe.encoded(df.limit(0)).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_boosted_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.7)).astype(float)
    m = toxicity.Boosted().fit(x[:1000], y[:1000])
    assert ((m.raw(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    at, p = toxicity.isotonic(m.raw(x), y)
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def insulting(rng, n):
    w = prose(rng, n).split()
    for _ in range(max(3, n // 20)):
        w[rng.randrange(len(w))] = rng.choice(["you idiot", "you moron", "worthless scum", "1d1ot"])
    return " ".join(w)


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    texts = [(insulting if i % 4 == 0 else prose)(rng, rng.randrange(20, 200)) for i in range(600)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    m = toxicity.fit(df, labels)
    out = {r["doc_id"]: r["toxic"] for r in toxicity.score(df, m).collect()}
    assert sum(out[i] == (i % 4 == 0) for i in range(400, 600)) >= 195
    assert {r["doc_id"] for r in toxicity.keep_clean(df, m).collect()} == {i for i in out if not out[i]}


def test_toxicity_awkward(spark):
    df = awkward(spark)
    m = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert m.trees is None and toxicity.score(df, m).count() == 8 and toxicity.keep_clean(df, m).columns == df.columns
    assert toxicity.keep_clean(df, m).count() == 8 and toxicity.score(df.limit(0), m).count() == 0
    assert toxicity.keep_clean(docs(spark, ["you idiot", "fine"]), m).count() == 1


# --- decontamination --------------------------------------------------------------------------------------------


def distances(a, text):
    """Edits of the best place of a ending at each position of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def test_alignment_against_the_plain_recurrence():
    rng = random.Random(7)
    for _ in range(150):
        a = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(3) for _ in range(rng.randrange(60))]
        d = distances(a, text)
        best = min(d)
        assert decontamination.nearest(a, text, len(a)) == (best, d.index(best)) or best == len(a)
        got = decontamination.align(a, text, d.index(best), best)
        assert got[0] == best and distances(a, text[got[1] : d.index(best)])[-1] == best


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, n, 500) for n in (12, 30, 60)] + ["short", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def edited(t, n):
        c = list(t)
        for _ in range(n):
            at = rng.randrange(len(c))
            c[at : at + rng.choice([0, 1])] = rng.choice(["", "q"])
        return "".join(c)

    texts, want = [], set()
    for k in range(3):
        for share in (0, 0.03, 0.07, 0.3):
            want |= {(len(texts), k)} if share < 0.2 else set()
            texts.append(prose(rng, 200, 500) + ". " + edited(items[k], int(share * len(items[k]))).upper() + ", " + prose(rng, 100, 500))
    texts += [prose(rng, 300, 500), None, "", items[1][: len(items[1]) // 2]]
    df = docs(spark, texts)
    got = decontamination.matches(df, bench)
    assert got.columns == ["doc_id", "item_id", "edits", "first_char", "end_char"]
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    for r in got.collect():
        a = decontamination.normalised(items[r["item_id"]])[0].tolist()
        piece = decontamination.normalised(texts[r["doc_id"]][r["first_char"] : r["end_char"]])[0].tolist()
        assert min(distances(a, piece)) <= r["edits"] <= 0.1 * len(a)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(df, bench, bytes_=10).collect()} == want
    kept = decontamination.keep_clean(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == df.columns
    assert decontamination.keep_clean(awkward(spark), bench).count() == 8
    assert decontamination.matches(df, bench.limit(0)).count() == decontamination.matches(df.limit(0), bench).count() == 0


def test_short_items(spark):
    items = ["42", "Yes!", "no", "東京", "a-b", "q" * 8, "yes", "?", "ไทย"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["The answer: 42.", "142 and 4 2, yesterday", "Oh YES; a  b", "私は東京に住む", "no", "know", "", None, "東 京", "yes " * 3, "x " + "q" * 8, "ภาษาไทยดี"]
    got = {(r["doc_id"], r["item_id"], r["edits"], texts[r["doc_id"]][r["first_char"] : r["end_char"]]) for r in decontamination.matches(docs(spark, texts), bench).collect()}
    assert got == {(0, 0, 0, "42"), (2, 1, 0, "YES"), (2, 6, 0, "YES"), (2, 4, 0, "a  b"), (3, 3, 0, "東京"), (4, 2, 0, "no"), (9, 1, 0, "yes"), (9, 6, 0, "yes"), (10, 5, 0, "q" * 8), (11, 8, 0, "ไทย")}
    assert rows(decontamination.keep_clean(docs(spark, texts), bench).select("doc_id")) == [(1,), (5,), (6,), (7,), (8,)]
    assert decontamination.matches(docs(spark, texts), bench, bytes_=1).count() == len(got)


# --- licences ---------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = next(t for k, t in license_texts.TEXTS if k == "MIT")
    variants = ["Copyright (c) 2020 Someone\n\n" + mit, "  © 1999 X.\nAll rights reserved.\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), " ".join(mit.split()).replace('"', "“")]
    texts = [*variants, mit + " And more.", "Some text.\nReleased under the MIT Licence.\nMore.", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "mit", None, ""]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert [got[i][0] for i in range(4)] == ["MIT", "MIT", "MIT", None]
    assert got[4] == (None, "MIT") and got[5] == ("Apache-2.0", "Apache-2.0") and got[6] == (None, "CC-BY-NC-4.0,GPL-3.0")
    assert got[7] == got[8] == got[9] == (None, None)
    a = license_scan.scan(awkward(spark))
    assert a.count() == 8 and license_scan.scan(docs(spark, [None]).limit(0)).count() == 0
    own = license_scan.scan(docs(spark, ["x y"]), license_scan.known(spark).limit(0)).collect()
    assert len(own) == 1 and own[0]["license"] is None


def test_copyright_lines_of_names(spark):
    lines = ["Copyright Joyent, Inc. and other Node contributors.", "Copyright Microsoft Corporation", "Copyright John Doe, 2015", "# Copyright The Regents of X", "Portions Copyright Ärzte e. V.", "COPYRIGHT ORACLE AND OTHERS"]
    mit = next(t for k, t in license_texts.TEXTS if k == "MIT")
    texts = [f"{x}\n\n{mit}" for x in lines]
    got = [r["license"] for r in license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT"] * len(lines)
    # the licences' own sentences stay, wherever their lines begin
    own = [(k, re.sub(r"\s+(?=copyright\b)", "\n", t, flags=re.I)) for k, t in license_texts.TEXTS]
    own += [(k, t.upper()) for k, t in own]
    assert any("\ncopyright" in t for _, t in own)
    whole = {r["doc_id"]: r["license"] for r in license_scan.scan(docs(spark, [t for _, t in own])).collect()}
    assert [whole[i] for i in range(len(own))] == [k for k, _ in own]
    kept = spark.createDataFrame([(f"copyright {x} of the work",) for x in ("holder", "holders", "owner", "notice", "license", "and permission notice")], "t string")
    assert all("copyright" in r[0] for r in kept.select(license_scan.canonical(F.col("t"))).collect())


# --- sharding ---------------------------------------------------------------------------------------------------


def tree(x, w, at, whole, target, path, out):
    """The k-d tree by the definition."""
    extent = [(max(x[i][d] for i in at) - min(x[i][d] for i in at)) / max(whole[d], 1) for d in range(len(whole))]
    if sum(w[i] for i in at) <= target or max(extent) == 0:
        out.update(dict.fromkeys(at, path))
        return
    d = extent.index(max(extent))
    values, total = sorted({x[i][d] for i in at}), sum(w[i] for i in at)
    cut = next(v for v in values if 2 * sum(w[i] for i in at if x[i][d] <= v) >= total)
    cut -= cut == values[-1]
    tree(x, w, [i for i in at if x[i][d] <= cut], whole, target, path + "0", out)
    tree(x, w, [i for i in at if x[i][d] > cut], whole, target, path + "1", out)


@pytest.mark.parametrize("local_rows", [1000, 7])
def test_shards_against_brute_force(spark, local_rows):
    rng = random.Random(9)
    data = [(i, "t" * rng.randrange(1, 200), rng.choice(["en", "de", None]), f"s{rng.randrange(4)}", rng.choice([None, rng.randrange(10**rng.randrange(1, 8))])) for i in range(120)]
    df = spark.createDataFrame(data, DOCS)
    dims = ("lang", "source", "n_chars", "doc_id")
    x = [tuple(r) for r in df.orderBy("doc_id").select(*[sharding.dimension(df, c) for c in dims]).collect()]
    whole = [max(v) - min(v) for v in zip(*x)]
    want = {}
    tree(x, [len(r[1]) for r in data], list(range(120)), whole, 900, "", want)
    got = sharding.shards(df, dims, target=900, local_rows=local_rows)
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == want
    assert got.groupBy("shard").agg(F.sum("bytes").alias("b")).where("b > 900").count() == 0


def test_shards_awkward(spark):
    df = awkward(spark)
    got = sharding.shards(df, ("keep_id", "_digest"), target=10)
    assert got.count() == 8 and got.columns == ["doc_id", "bytes", "shard"]
    same = docs(spark, ["x" * 50]).unionByName(docs(spark, ["x" * 50]))
    assert {r["shard"] for r in sharding.shards(same, target=10).collect()} == {""}
    assert sharding.shards(df.limit(0), ("keep_id",)).count() == 0


# --- WARC -------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rng = random.Random(10)
    data = [(i, f"http://h/{i}", f"<html><head><title>{i}</title></head><body>{prose(rng, 50)}</body></html>") for i in range(200)]
    data += [(None, None, None), (3, "bad\r\nurl", ""), (3, "http://h/3", "é" * 40000), (3, "http://h/3", "é" * 40000)]
    pages = spark.createDataFrame([(*r, r[0]) for r in data], "page_id long, url string, html string, offset long")
    to = str(tmp_path / "w")
    index = warc.write(pages, to, file_bytes=20000)
    assert index.columns == ["page_id", "url", "file", "offset", "length", "raw_length", "digest"] and index.count() == len(data)
    back = warc.read(spark, to)
    assert back.where("not intact").count() == 0
    got = sorted((r["url"] or "", bytes(r["body"])) for r in back.collect())
    assert got == sorted((warc.clean(u), (h or "").encode()) for _, u, h in data)
    for r in index.limit(5).collect():
        with open(f"{to}/{r['file']}", "rb") as f:
            raw = f.read()
        z, first = warc.opened(raw)
        assert first <= r["offset"] and len(z.decompress(raw[r["offset"] : r["offset"] + r["length"]])) == r["raw_length"]
    assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
    assert warc.round_trip(pages).where("not round_trip").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_dictionary_pays():
    rng = random.Random(11)
    head = prose(rng, 100)
    made = [f"{head} {prose(rng, 20)}".encode() for _ in range(400)]
    with_, without = (sum(map(len, list(warc.archive(made, size=s))[1:])) for s in (1 << 16, 0))
    assert with_ < 0.7 * without


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 40)
    base = [prose(rng, 150) for _ in range(120)]
    toxic = [insulting(rng, 80) for _ in range(60)]
    near = base[0].split()
    near[10] = "changed"
    texts = base + toxic + [base[1], " ".join(near), base[2] + " " + item + " " + prose(rng, 120), None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 120)) for i in range(180)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    enc = bpe.encoding()
    want = {i: enc.encode_ordinary(texts[i]) for i in range(120)} | {183: None, 184: []}
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
