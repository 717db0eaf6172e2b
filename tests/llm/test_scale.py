"""What holds whatever the size and the layout of the input: repeated ids, partitions that change, classes beyond a task, whole queries by brute force."""

import math
import random
import re
import struct

import numpy as np
import pytest
import zstandard

from tidemark.llm import common, decontamination, line_dedup, near_dedup, sharding, substring_dedup, toxicity, verify, warc

from .test_dedup import docs, prose, rows, spans_brute, words
from .test_text import distances, insulting, tree

# --- repeated ids -------------------------------------------------------------------------------------------------


def numbered(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def test_keep_one_of_repeated_ids(spark):
    w, u = numbered("w", 80), numbered("u", 80)
    df = table(spark, [(1, w), (2, w), (2, u), (3, u + " x"), (4, w.upper()), (2, u)])
    assert rows(near_dedup.keep_one(df)) == sorted([(1, w), (2, u), (2, u)], key=str)
    assert rows(near_dedup.duplicates(df)) == [(2, 1), (3, 2), (4, 1)]
    lines = table(spark, [(1, "the first line of all\nsomething else here"), (2, "the first line of all"), (2, "only here, and nowhere else")])
    assert rows(line_dedup.keep_one(lines)) == sorted([(1, "the first line of all\nsomething else here"), (2, ""), (2, "only here, and nowhere else")], key=str)
    got = rows(substring_dedup.keep_one(table(spark, [(1, w), (2, w), (2, u)])))
    assert got == sorted([(1, w), (2, ""), (2, u)], key=str)


def test_words_of_scripts_without_blanks(spark):
    rng = random.Random(1)
    han = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(200))
    near = han[:50] + "水" + han[51:]
    got = common.Words([f"ab {han[:2]}cd。x", "ไทย"], plain=True)
    assert [got.parts[i][s - got.first[i] : e - got.first[i]].decode() for i in range(2) for s, e in zip(got.start[got.doc[i] : got.doc[i + 1]], got.end[got.doc[i] : got.doc[i + 1]])] == ["ab", *han[:2], "cd。x", "ไ", "ท", "ย"]
    df = docs(spark, [han, near, "x " + han[:120] + " y", "漢" * 10])
    assert rows(near_dedup.duplicates(df.where("doc_id <> 2"))) == [(1, 0)]
    spans = {tuple(r)[:5] for r in substring_dedup.spans(df).collect()}
    assert (2, 1, 121, 2, 0) in spans and (1, 51, 200, 2, 0) in spans
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.keep_one(df).collect()}
    assert kept[2] == "x y"


# --- partitions that come out otherwise, groups beyond a task ------------------------------------------------------


class Lost(common.Routed):
    """The first table of a kind tells no partition anything."""

    made: set = set()

    def __init__(self, spark, df, what):
        super().__init__(spark, df, what)
        if what not in Lost.made:
            Lost.made.add(what)
            self.files = []


@pytest.mark.parametrize("module", [near_dedup, line_dedup, substring_dedup])
def test_partitions_that_change(spark, monkeypatch, module):
    rng = random.Random(2)
    base = [prose(rng, 120) for _ in range(4)]
    texts = [b + tail for b in base for tail in ("", " more", " and more")]
    run = {near_dedup: near_dedup.duplicates, line_dedup: line_dedup.duplicates, substring_dedup: substring_dedup.spans}[module]
    want = rows(run(docs(spark, texts)))
    Lost.made = set()
    monkeypatch.setattr(module, "Routed", Lost)
    assert len(want) >= 8 and rows(run(docs(spark, texts))) == want and Lost.made


def test_linked_against_pairs():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(14), rng.randrange(0, 9))), np.int64) for _ in range(60)]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a & b and len(a & b) >= 0.6 * len(a | b):
                x, y = sorted((up[i], up[j]))
                up = [x if r == y else r for r in up]
    assert verify.linked(sets, 0.6).tolist() == up
    assert verify.linked([], 0.6).tolist() == []


@pytest.mark.parametrize("group", [4, 11])
def test_classes_beyond_a_group(spark, monkeypatch, group):
    """One prefix of more suffixes than fit: they part at several depths, some at once, some after long common stretches."""
    rng = random.Random(4)
    head, mid = numbered("h", 8), numbered("m", 6)
    texts = [f"{rng.randrange(50)}a {head} {rng.choice(['', mid, mid + ' ' + mid])} {rng.choice('xyz')} {rng.choice('pq')} z{i}" for i in range(40)] + [f"b {head}", f"c {head} {mid}", f"{mid} {head} {mid} {mid} x"]
    calls, extended = [], substring_dedup._extended
    monkeypatch.setattr(substring_dedup, "_extended", lambda *a: calls.append(a) or extended(*a))
    got = [tuple(r) for r in substring_dedup.spans(docs(spark, texts), least=5, group=group).collect()]
    whole = [tuple(r) for r in substring_dedup.spans(docs(spark, texts), least=5).collect()]
    assert len(calls) == 1 and sorted(got) == sorted(whole)
    assert {r[:3] for r in got if (r[0], r[1]) != r[4:]} == spans_brute(texts, 5)
    w = [words(t) for t in texts]
    for i, a, b, copies, j, c in got:
        p = w[i][a:b]
        found = [(k, q) for k, x in enumerate(w) for q in range(len(x) - len(p) + 1) if x[q : q + len(p)] == p]
        assert len(found) == copies > 1 and found[0] == (j, c)


def test_deep_classes_take_few_rounds(spark, monkeypatch):
    """Runs of one word: the subtree of their prefix is a chain, of which each round once took off one link. Whole groups and small ones give what brute force gives."""
    texts = [f"{'ab'[i % 2]}{i} {'the ' * (60 + 7 * i)}{'cd'[i % 2]} x{i % 3} y{i}" for i in range(8)] + [f"u {'the ' * 40} v {'the ' * 90} c x0 z", "the " * 110]
    made, written = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, what: made.append(what) or written(df, what))
    got = [tuple(r) for r in substring_dedup.spans(docs(spark, texts), least=5, group=100).collect()]
    assert 3 <= made.count("big") <= 10 and len(made) <= 40  # a deepest repeat of about 110 words
    monkeypatch.setattr(substring_dedup, "_SORT", 10**9)
    assert sorted(got) == sorted(tuple(r) for r in substring_dedup.spans(docs(spark, texts), least=5).collect())
    assert {r[:3] for r in got if (r[0], r[1]) != r[4:]} == spans_brute(texts, 5)


def test_halves_against_sorting():
    rng = random.Random(6)
    for _ in range(60):
        after = [np.array([rng.choice((1, 1, 1, rng.randrange(3), 5 + d)) for _ in range(rng.randrange(1, 40))], np.int64) for d in range(6)]
        after = [np.append(a, 100 + d) for d, a in enumerate(after)]  # the ends differ
        base = np.cumsum([0, *map(len, after)])
        suffixes = sorted(rng.sample([(d, k) for d, a in enumerate(after) for k in range(len(a))], 6))
        suffixes += [x for x in [(d, k) for d, a in enumerate(after) for k in range(len(a))] if x not in suffixes and rng.random() < 0.8]
        want = substring_dedup.repeats([k for _, k in suffixes], [(d, 0) for d, _ in suffixes], [after[d][k:].astype(">u4").tobytes() for d, k in suffixes], [np.arange(k, len(after[d])) for d, k in suffixes], 5)
        want = [x for x in want if x[1] > suffixes[x[0]][1] + 5]  # some word is shared
        d, k = np.array(suffixes).T
        one = np.ones(len(d), np.int64)
        m = np.diff(base)[d] - k
        s, shared, copies, first = substring_dedup.halves(np.concatenate(after).view(np.uint64), base[d] + k, m, substring_dedup._order(d, k), one, one * 0, one * 64, one, one > 0)
        stop = k[s] + shared + 5
        got = [x for x in zip(s.tolist(), stop.tolist(), copies.tolist(), first.tolist()) if x[1] > suffixes[x[0]][1] + 5]
        assert len(got) > 10 and sorted(got) == sorted(map(tuple, want))


# --- whole queries by brute force ----------------------------------------------------------------------------------


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(5)
    items = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(150))) for _ in range(30)]
    for k in range(120):
        c = list(rng.choice(items))
        for _ in range(rng.randrange(6)):
            c[rng.randrange(len(c) or 1) : rng.randrange(len(c) or 1) + 1] = rng.choice(["", "a", "bb"])
        i = rng.randrange(len(texts))
        texts[i] = texts[i][:40] + "".join(c) + texts[i][40:]
    bench = spark.createDataFrame([(k, None, t) for k, t in enumerate(items)] + [(None, None, "aaaa bbbb cccc")], "edits long, text string, question string")
    got = decontamination.matches(docs(spark, texts), bench, item_col="edits", item_text_col="question")
    assert got.columns == ["doc_id", "edits_", "edits", "first_char", "end_char"]
    want = set()
    for d, t in enumerate(texts):
        a = decontamination.normalised(t)[0]
        edge = decontamination.boundaries(a)
        for k, item in enumerate(items):
            x = decontamination.normalised(item)[0]
            n = len(x)
            if n >= decontamination.Q:
                best = min(distances(x.tolist(), a.tolist()))
                want |= {(d, k, best)} if best <= decontamination.budget(n) else set()
            elif n and any(edge[s] and edge[s + n] and a[s : s + n].tolist() == x.tolist() for s in range(len(a) - n + 1)):
                want |= {(d, k, 0)}
    assert {(r[0], r[1], r[2]) for r in got.collect()} == want and len(want) > 20
    assert decontamination.matches(docs(spark, texts).withColumnRenamed("doc_id", "first_char"), bench, "first_char", item_col="edits", item_text_col="question").columns[0] == "first_char_"


def plain_features(text, learnt):
    w = [x for x in re.split(r"[ \t\n\r\x0b\x0c!-/:-@\[-`{-~]+", text.lower()) if x]
    n, raw = max(len(w), 1), text.encode()
    hit = [x in toxicity.LEXICON for x in w]
    known = [x.encode() in learnt for x in w]
    near = sum((a or b) and any(x in toxicity.SECOND for x in w[max(0, i - 5) : i + 6]) for i, (a, b) in enumerate(zip(hit, known)))
    loud = sum(len(x) > 2 and x.isupper() and x.lower() in toxicity.LEXICON for x in re.split(r"[\s!-/:-@\[-`{-~]+", text))
    odd = {x for x in text.lower().split() if toxicity._SWAPPED.search(x)}
    spaced = [m[0] for m in toxicity._SPACED.finditer(text)]
    undone = sum(x.translate(toxicity._LEET).strip(".,;:?\"'()") in toxicity.LEXICON or re.sub(r"[\W\d_]", "", x) in toxicity.LEXICON for x in odd) + sum(re.sub(r"[\W_]", "", x).lower() in toxicity.LEXICON for x in spaced)
    share = lambda f: 100 * sum(map(f, raw)) / len(raw)
    return [
        100 * sum(hit) / n, 100 * sum(known) / n, 100 * sum(learnt.get(x.encode(), 0) for x in w) / n, 100 * near / n, 100 * sum(x in toxicity.SECOND for x in w) / n, 100 * loud / n, share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57),
        share(lambda c: 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126), share(lambda c: c == 33), 100 * (len(odd) + len(spaced)) / n, 100 * undone / n, math.log1p(len(w)), sum(hit) + sum(known) + undone,
    ]


def plain_probability(m, x):
    f = m.trees.base
    for on, at, leaf in zip(m.trees.split_on.tolist(), m.trees.split_at.tolist(), m.trees.leaf.tolist()):
        i = 0
        while i < len(on):
            i = 2 * i + 1 + (x[on[i]] > at[i])
        f += leaf[i - len(on)]
    return float(np.interp(f, *m.curve)) if x[12] > 0 else float(m.curve[1][0])


def test_toxicity_against_plain_version(spark):
    rng = random.Random(6)
    texts = [(insulting if i % 3 == 0 else prose)(rng, rng.randrange(5, 120)) for i in range(300)] + ["YOU IDIOT!!!", "s.t.u.p.i.d", "", "...", "you 1d1ot, Ünï", "x" * 200_000 + " moron", None]
    df = docs(spark, texts)
    m = toxicity.fit(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert m.trees is not None
    got = {r["doc_id"]: r["probability"] for r in toxicity.score(df, m).collect()}
    for i, t in enumerate(texts):
        if t:
            x = plain_features(t, m.learnt)
            assert np.allclose(x, toxicity.features(t, m.learnt)), t[:50]
            assert abs(got[i] - plain_probability(m, x)) < 1e-6
    assert got[len(texts) - 1] == round(float(m.curve[1][0]), 6)


def test_isotonic_against_definition():
    """The fit at i is the largest over a <= i of the smallest over b >= i of the mean of a..b."""
    rng = random.Random(7)
    score, y = np.arange(40.0), np.array([float(rng.random() < i / 40) for i in range(40)])
    at, p = toxicity.isotonic(score, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(np.interp(score, at, p), want)


def test_toxicity_clashing_names_and_whole_lexicon(spark):
    rng = random.Random(8)
    odd = [f"bad{i}" for i in range(5000)]
    texts = [" ".join(odd) + " " + prose(rng, 30) + f" t{i}" if i % 2 else prose(rng, 50) for i in range(100)]
    df = docs(spark, texts).withColumnsRenamed({"doc_id": "probability", "text": "a.b"})
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "probability long, toxic int")
    m = toxicity.fit(df, labels, "probability", "a.b")
    assert len(set(m.learnt) & {w.encode() for w in odd}) == 5000
    out = toxicity.score(df, m, "probability", "a.b")
    assert out.columns == ["probability_", "probability", "toxic"] and out.count() == 100
    assert toxicity.keep_clean(df, m, "a.b").columns == df.columns


def test_shards_of_the_sizes_query(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, "t" * rng.randrange(1, 30_000), rng.choice(["en", "de"]), f"s{rng.randrange(4)}", rng.randrange(1000)) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    x = [tuple(r) for r in df.orderBy("doc_id").select(*[sharding.dimension(df, c) for c in ("lang", "source", "n_chars", "doc_id")]).collect()]
    want: dict = {}
    tree(x, [len(r[1]) for r in data], list(range(120)), [max(v) - min(v) for v in zip(*x)], 256 << 10, "", want)
    got = {r["shard"]: (r["documents"], r["bytes"]) for r in sharding.sizes_query(spark, str(tmp_path)).collect()}
    assert len(got) > 5 and got == {p: (sum(v == p for v in want.values()), sum(len(data[i][1]) for i, v in want.items() if v == p)) for p in set(want.values())}


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_read_by_the_layout_alone(spark, tmp_path):
    """Files of one, few and many records by a plain reader: every one has a dictionary, and every record is there whole."""
    rng = random.Random(10)
    data = [(i, f"http://h/{i}", f"<p>{prose(rng, 60)}</p>" * rng.choice([1, 1, 1, 30])) for i in range(60)] + [(60, None, None), (61, "u", "é" * 40_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    to = str(tmp_path / "w")
    warc.write(pages.repartition(3), to, file_bytes=3000)
    found, sizes = [], []
    for f in (tmp_path / "w").glob("*.warc.zst"):
        raw = f.read_bytes()
        magic, n = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        sizes.append(n)
        z, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])), raw[8 + n :]
        while rest:
            d = z.decompressobj()
            head, _, body = d.decompress(rest).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert body[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            found.append((fields["WARC-Target-URI"], body[:-4].decode()))
            rest = d.unused_data
    assert len(sizes) > 20 and min(sizes) > 0
    assert sorted(found) == sorted((u or "", t or "") for _, u, t in data)
    with pytest.raises(ValueError):
        warc.write(pages.limit(5), to)
    assert warc.read(spark, to).count() == len(data)
