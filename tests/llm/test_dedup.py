"""Exact dedup, near-dedup, line dedup and substring dedup against brute force."""

import random
import re

import pytest

from tidemark.llm import components, exact_dedup, line_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def awkward(spark):
    """Nulls in every column, empty and repeated texts, ties, and columns with names that operators use inside."""
    data = [(1, "a b c", None, 1), (None, "a b c", "x", 2), (1, "a b c", "x", 3), (2, None, None, None), (2, "", None, 4), (3, "", None, 5), (4, "a b c " * 30000, None, 6), (5, "\n\n \n", "y", 7)]
    return spark.createDataFrame(data, "doc_id long, text string, keep_id string, _digest long")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (None, 1)] + [(i, i + 1) for i in range(100, 150)], "a long, b long")
    got = dict(rows(components.components(edges)))
    assert got == {2: 1, 3: 1, 5: 4} | {i: 100 for i in range(101, 151)}
    assert components.components(edges.limit(0)).count() == 0


def test_exact(spark):
    df = docs(spark, ["x", "y", "x", None, "", None, "", "x"])
    out = exact_dedup.deduplicate(df, copies="n")
    assert {(r["doc_id"], r["n"]) for r in out.collect()} == {(0, 3), (1, 1), (3, 1), (4, 2), (5, 1)}
    assert out.columns == [*df.columns, "n"] and exact_dedup.deduplicate(df).columns == df.columns
    a = exact_dedup.deduplicate(awkward(spark)).collect()
    assert sorted((str(r["doc_id"]), r["_digest"]) for r in a if r["text"] == "a b c") == [("1", 1)] and len(a) == 5
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.deduplicate(df, copies="LANG")


def near_brute(texts, threshold=near_dedup.THRESHOLD):
    sets = []
    for t in texts:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        n = near_dedup.SHINGLE
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in range(len(texts)) if root(i) != i}


def test_near_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for i in range(40):
        base = prose(rng, rng.choice([2, 5, 40, 200, 600])).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, len(w) // 20, len(w) // 8])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [None, "", "...", "one", "One!"]
    rng.shuffle(texts)
    got = dict(rows(near_dedup.duplicates(docs(spark, texts))))
    want = near_brute(texts)
    assert len(set(got.items()) & set(want.items())) >= 0.95 * len(want) and set(got) <= set(want)


def test_near_awkward(spark):
    df = awkward(spark)
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert near_dedup.duplicates(df).columns == ["doc_id", "keep_id"]
    assert near_dedup.duplicates(df.limit(0)).count() == 0
    assert {r["_digest"] for r in out.collect()} >= {2, 4, 5, 7}


def test_large_components_by_joins(spark):
    """Verification by joins, for groups beyond a task's memory, finds the same."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import written
    from tidemark.llm.verify import verified

    rng = random.Random(4)
    base = prose(rng, 100).split()
    texts = [" ".join(base[:k] + ["x"] * 3 + base[k:]) for k in range(0, 90, 10)] + [prose(rng, 100) for _ in range(3)]
    t = written(docs(spark, texts).select(F.col("doc_id").alias("node"), "text"), "t")
    buckets = written(t.select(F.lit(1).cast("long").alias("key"), "node"), "b")
    get = lambda large: dict(rows(verified(buckets, lambda n: t.join(n, "node"), near_dedup.shingles, 0.6, large=large)))
    assert get(1 << 30) == get(10) == {i: 0 for i in range(1, 9)}


def line_sets(line):
    kept = bytes(b for b in line.lower().encode() if 48 <= b < 58 or 97 <= b < 123 or b >= 128)
    n = line_dedup.SHINGLE
    return {kept[i : i + n] for i in range(len(kept) - n + 1)} or ({kept} if kept else set())


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    lines = [prose(rng, rng.choice([1, 4, 12, 25])) for _ in range(40)]
    pool = lines + [(x + " extra" if rng.random() < 0.5 else x.upper()) for x in lines for _ in range(2)] + ["", "---"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(60)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in line_dedup.duplicates(docs(spark, texts)).collect()}
    every = [(i, j, line_sets(x)) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n"))]
    every = [x for x in every if x[2]]
    up = list(range(len(every)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(every)):
        for b in range(a):
            x, y = every[a][2], every[b][2]
            if len(x & y) >= line_dedup.THRESHOLD * len(x | y):
                r, s = sorted((root(a), root(b)))
                up[s] = r
    want = {every[i][:2]: every[root(i)][:2] for i in range(len(every)) if root(i) != i}
    assert set(got) <= set(want) and len(set(got.items()) & set(want.items())) >= 0.9 * len(want)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.keep_one(docs(spark, texts)).collect()}
    assert kept == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in got) for i, t in enumerate(texts)}


def test_lines_awkward(spark):
    df = awkward(spark)
    assert line_dedup.keep_one(df).columns == df.columns and line_dedup.keep_one(df).count() == df.count()
    assert line_dedup.duplicates(df.limit(0)).count() == 0


def words(t):
    return re.split("[ \t\n\v\f\r]+", t.strip(" \t\n\v\f\r")) if t.strip(" \t\n\v\f\r") else []


def spans_brute(texts, least):
    """The maximal stretches with an earlier occurrence."""
    w = [words(t) if t else [] for t in texts]
    out = set()
    for i, x in enumerate(w):
        upto = 0
        for p in range(len(x)):
            best = 0
            for j in range(i + 1):
                for q in range(len(w[j]) if j < i else p):
                    k = 0
                    while p + k < len(x) and q + k < len(w[j]) and x[p + k] == w[j][q + k]:
                        k += 1
                    best = max(best, k)
            if best >= least and p + best > upto:
                out.add((i, p, p + best))
                upto = p + best
    return out


@pytest.mark.parametrize(("letters", "least", "group"), [(3, 4, 200_000), (3, 6, 5), (2, 8, 3), (40, 5, 200_000)])
def test_spans_against_brute_force(spark, letters, least, group):
    rng = random.Random(letters * 100 + least)
    texts = []
    for _ in range(24):
        w = [str(rng.randrange(letters)) for _ in range(rng.randrange(50))]
        if texts and rng.random() < 0.5:
            o = words(rng.choice(texts))
            at = rng.randrange(len(o) + 1)
            w[len(w) // 2 : len(w) // 2] = o[at : at + rng.randrange(40)]
        texts.append("  ".join(w))
    got = [tuple(r) for r in substring_dedup.spans(docs(spark, texts), least=least, group=group).collect()]
    assert {r[:3] for r in got if (r[0], r[1]) != r[4:]} == spans_brute(texts, least)
    w = [words(t) for t in texts]
    for i, a, b, copies, j, c in got:
        p = w[i][a:b]
        found = [(k, q) for k, x in enumerate(w) for q in range(len(x) - len(p) + 1) if x[q : q + len(p)] == p]
        assert len(found) == copies > 1 and found[0] == (j, c)


def test_spans_of_copies(spark):
    rng = random.Random(8)
    p, q = prose(rng, 60), prose(rng, 300)
    texts = [p, prose(rng, 80) + "\n" + p + " " + prose(rng, 80), q, q, prose(rng, 200), None, ""]
    got = {tuple(r) for r in substring_dedup.spans(docs(spark, texts)).collect()}
    assert got == {(0, 0, 60, 2, 0, 0), (1, 80, 140, 2, 0, 0), (2, 0, 300, 2, 2, 0), (3, 0, 300, 2, 2, 0)}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.keep_one(docs(spark, texts)).collect()}
    assert kept[0] == p and kept[3] == "" and len(words(kept[1])) == 160 and kept[5] is None and kept[4] == texts[4]


def test_spans_awkward(spark):
    df = awkward(spark)
    assert substring_dedup.keep_one(df).columns == df.columns
    assert substring_dedup.spans(df.limit(0)).count() == 0
    got = [tuple(r) for r in substring_dedup.spans(df).collect()]
    assert got and {r[0] for r in got} == {4}
    twice = docs(spark, ["a " * 20]).unionByName(docs(spark, ["b c " * 40])).unionByName(docs(spark, ["b c " * 40]))
    assert {r[0] for r in substring_dedup.spans(twice).collect()} <= {0}
