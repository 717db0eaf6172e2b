"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds its word 3-shingles; its sketch the K smallest of their hashes. Inverted lists (retained
value -> documents) generate overlaps. Only the rarest values of each sketch are listed: two sketches of n values
that share m or more share one of the first n - m + 1 in any common order, so with the rarest first lists of boilerplate
aren't paired. m is what similar sets share but for SLACK standard deviations, so a qualifying pair can be lost, rarely.
Lists of the same documents count once. Within a list
similarities are estimated from the bottom K of the union of two sketches; documents that are linked by estimates not
clearly below the threshold are a bucket, whose documents are verified by their exact Jaccard similarity. A pair that is linked already is not estimated again, so a list
of n copies costs about n estimates, and nothing that is shuffled grows with the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Routed, Words, fresh, grams, lists, mix, pieces, signed, written
from .verify import candidates, confirmed, positive

#: Words in a shingle, values in a sketch, Jaccard similarity from which two documents are near duplicates, and
#: standard deviations of slack in the two filters before the exact check.
SHINGLE, K, THRESHOLD, SLACK = 3, 32, 0.6, 3.0


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words than a shingle has one, made of all
    its words; one without words has none."""
    w = Words(texts)
    out = []
    for a, b in zip(w.doc[:-1], w.doc[1:]):
        h = w.hash[a:b]
        g = grams(h, SHINGLE if len(h) >= SHINGLE else max(len(h), 1))
        out.append(np.unique(positive(g)).view(np.uint64))
    return out


def _digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's sequence of words."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        d = np.zeros(len(w.parts), np.uint64)
        c = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash * np.uint64(seed | 1) + mix((np.arange(len(w.hash)) - np.repeat(w.doc[:-1], np.diff(w.doc)) + 1).astype(np.uint64) * np.uint64(seed))), dtype=np.uint64)])
        d = mix(c[w.doc[1:]] - c[w.doc[:-1]] + np.diff(w.doc).astype(np.uint64))
        out.append(d)
    return out[0], out[1]


def _sketch(k: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        for b in pieces(batches, 1):
            w = Words(b.column(1).to_pylist())
            d1, d2 = _digests(w)
            has, rows = np.diff(w.doc) > 0, []
            long_ = grams(w.hash, SHINGLE)
            for a, e in zip(w.doc[:-1], w.doc[1:]):
                if e - a >= SHINGLE:
                    g = positive(long_[a : e - SHINGLE + 1])
                else:
                    g = positive(grams(w.hash[a:e], max(e - a, 1)))
                low = np.unique(np.partition(g, 2 * k)[: 2 * k] if len(g) > 4 * k else g)
                if len(low) < k and len(g) > 4 * k:
                    low = np.unique(g)
                rows.append(low[:k])
            n = np.array([len(r) for r in rows])
            own = [b.column(0), b.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(signed(d1)), pa.array(signed(d2))]
            out = pa.RecordBatch.from_arrays([*own, lists(np.concatenate([*rows, np.zeros(0, np.int64)]), n, pa.int64())], ["id", "x", "part", "d1", "d2", "s"])
            yield out.filter(pa.array(has))

    return run


def estimates(x: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimated Jaccard similarity of one sketch to each of others, and how many values each estimate is from. Sketches are sorted
    and filled up with the largest number."""
    k = len(x)
    both = np.sort(np.concatenate([np.broadcast_to(x, others.shape), others], 1), 1)
    first = np.ones(both.shape, bool)
    first[:, 1:] = both[:, 1:] != both[:, :-1]
    first &= both != _NONE
    rank = first.cumsum(1)
    twice = ~first & (both != _NONE) & (rank <= k)
    size = np.minimum(rank[:, -1], k)
    return twice.sum(1) / np.maximum(size, 1), size


_NONE = np.iinfo(np.int64).max


def linked(sketches: np.ndarray, threshold: float, slack: float) -> list[np.ndarray]:
    """The groups of two or more sketches that estimates link, directly or through others."""
    out, open_ = [], np.arange(len(sketches))
    while len(open_) > 1:
        group, rest, i = [open_[:1]], open_[1:], 0
        todo = [int(open_[0])]
        while i < len(todo) and len(rest):
            e, n = estimates(sketches[todo[i]], sketches[rest])
            ok = e >= threshold - slack * np.sqrt(threshold * (1 - threshold) / np.maximum(n, 1))
            group.append(rest[ok])
            todo += rest[ok].tolist()
            rest, i = rest[~ok], i + 1
        if len(todo) > 1:
            out.append(np.concatenate(group))
        open_ = rest
    return out


def _buckets(k: int, threshold: float, slack: float):
    """Inverted lists, one after the other, to buckets."""

    def run(batches):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, k), np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [none]  # of the list that may go on

        def done(v, nodes, rows):
            new = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v)) if len(v) else np.zeros(1, np.int64)
            keys, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(new[:-1].tolist(), new[1:].tolist()):
                for i, g in enumerate(linked(rows[a:b], threshold, slack)):
                    keys.append(np.full(len(g), mix(np.array([v[a]]).view(np.uint64) + np.uint64(i)).view(np.int64)[0]))
                    members.append(nodes[a:b][g])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], ["key", "node"])

        for b in batches:
            s = b.column(2)
            n = np.diff(s.offsets.to_numpy())
            m = np.full((len(n), k), _NONE, np.int64)
            m[np.arange(k) < n[:, None]] = s.flatten().to_numpy()
            values, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = int(np.searchsorted(values, values[-1])) if len(values) else 0
            last = held[-1][0]
            if at or len(last) and len(values) and last[-1] != values[0]:  # what is held is whole
                yield done(*map(np.concatenate, zip(*held, (values[:at], nodes[:at], m[:at]))))
                held = [none]
            held.append((values[at:], nodes[at:], m[at:]))
        yield done(*map(np.concatenate, zip(*held)))

    return run


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(comp, node, text) of the wanted documents, (comp, node, d1, d2, id, part), written. Every input partition is told which of its documents are
    wanted, so texts aren't shuffled to find them; should partitions come out otherwise than before, the rest is found by a join."""
    route = Routed(rows.sparkSession, wanted, "places")

    def right(b: pa.RecordBatch, of: dict) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        d1, d2 = _digests(Words(texts))
        got = [(*of[k], t) for k, t in zip(zip(b.column(0).to_pylist(), signed(d1).tolist(), signed(d2).tolist()), texts) if k in of]
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["comp", "node", "text"])

    def here(batches):
        mine = route.mine()
        if mine is None:
            return
        of = {k[:3]: k[3:] for k in zip(*(mine.column(c).to_pylist() for c in ("id", "d1", "d2", "comp", "node")))}
        ids = np.unique(mine.column("id").to_numpy())
        for b in batches:
            for x in pieces([b.filter(pa.array(np.isin(b.column(0).to_numpy(), ids)))], 1):
                yield right(x, of)

    def joined(batches):
        for b in pieces(batches, 1):
            c = [b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            yield right(b, {k[:3]: k[3:] for k in zip(*c)})

    kinds = "comp long, node long, text string"
    got = written(rows.select("id", "text").mapInArrow(here, kinds), "texts")
    rest = written(wanted.join(got, "node", "left_anti"), "rest")
    if rest.isEmpty():
        return got
    more = rows.join(rest, "id").select("id", "text", "d1", "d2", "comp", "node").mapInArrow(joined, kinds)
    return written(got.unionByName(more), "texts")


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, k: int, slack: float) -> DataFrame:
    """(id, x, keep, goes): the rows of the groups of two or more documents. x: a hash of the text; keep: the (id, d1, d2, x) that stays, d1 and d2 being a digest
    of its words."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).dropna()
    sk = written(rows.select("id", "text", F.xxhash64("text").alias("x")).mapInArrow(_sketch(k), "id long, x long, part int, d1 long, d2 long, s array<long>"), "sketches")
    # numbers once written: 64 bits of a digest wouldn't tell all nodes apart
    reps = sk.groupBy("d1", "d2").agg(F.min(F.struct("id", "part", "s")).alias("r")).select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "r.*")
    reps = written(reps, "nodes")

    posts = reps.select("node", F.size("s").alias("n"), F.explode("s").alias("v"))
    counts = posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = posts.join(counts, "v")
    need = lambda n: F.greatest(F.lit(1), F.floor(n * threshold - slack * F.sqrt(n * threshold * (1 - threshold))))
    own = W.partitionBy("node")
    first = shared.withColumn("r", F.row_number().over(own.orderBy("c", "v"))).withColumn("t", F.count("*").over(own))
    first = first.where(F.col("r") <= F.col("t") - need(F.col("n")) + 1).select("v", "node")  # n - t values are unique: they come before
    first = written(first, "postings")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    lists_ = first.groupBy("v").agg(F.count("*").alias("m"), *same).where("m > 1").groupBy("m", "x1", "x2").agg(F.min("v").alias("v")).select("v")
    held = first.join(lists_, "v", "left_semi").join(reps.select("node", "s"), "node").select("v", "node", "s")
    buckets = written(held.repartition("v").sortWithinPartitions("v").mapInArrow(_buckets(k, threshold, slack), "key long, node long"), "buckets")

    wanted = written(candidates(buckets).join(reps.drop("s"), "node"), "wanted")
    roots = written(confirmed(_texts(rows, wanted), buckets, shingles, threshold), "roots")
    of = [wanted.select(F.col("node").alias(n), F.col("d1").alias(f"{p}1"), F.col("d2").alias(f"{p}2")) for n, p in (("node", "d"), ("root", "g"))]
    roots = roots.join(of[0], "node").join(of[1], "root").select("d1", "d2", "g1", "g2")
    group = sk.select("id", "x", "d1", "d2").join(roots, ["d1", "d2"], "left").select("id", "x", "d1", "d2", F.coalesce("g1", "d1").alias("g1"), F.coalesce("g2", "d2").alias("g2"))
    row = F.struct("id", "d1", "d2", "x")
    kept = group.groupBy("g1", "g2").agg(F.min(row).alias("keep"), F.max(row).alias("hi")).where("keep <> hi").drop("hi")
    return group.join(kept, ["g1", "g2"]).select("id", "x", "keep", (row != F.col("keep")).alias("goes"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K, slack: float = SLACK) -> DataFrame:
    """(id, keep_id): every document that is a near duplicate, with the document of its group that stays, the one of the
    smallest id. Groups are the components of the pairs whose Jaccard similarity is `threshold` or more, so no pair joins two groups and membership
    is the whole result.

    Rows with a null id or text, and texts without words, are never duplicates. Rows repeated under the same id
    aren't duplicates of each other here. Each character of a script without blanks is a word. Of other columns, whatever their names, nothing depends. An empty
    table gives an empty one. Ids must be integers.
    """
    keep = fresh([id_col], "keep_id")
    out = _groups(docs, id_col, text_col, threshold, k, slack).where("id <> keep.id")
    return out.select(F.col("id").alias(id_col), F.col("keep.id").alias(keep)).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, but those of near duplicates; one document of each group stays, of the smallest id, on ties
    that of the smallest hash. Documents are told apart by id and text: of several texts under one id only near duplicates go; rows that repeat both are one document and stay
    or go together. Rows with null ids or texts stay."""
    gone, x = fresh(docs.columns, "_gone"), fresh(docs.columns, "_x")
    out = _groups(docs, id_col, text_col, threshold, K, SLACK).where("goes")
    out = out.select(F.col("id").alias(gone), F.col("x").alias(x)).distinct()
    return docs.join(out, (F.col(f"`{id_col}`").cast("long") == F.col(gone)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(x)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicates() of all documents."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


TOKENS = "list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= {THRESHOLD} * (na.n + nb.n - k) - 1e-9),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT a AS doc_id, min(b) AS keep_id FROM r GROUP BY a HAVING min(b) < a
"""
