"""Line dedup: fuzzy lines by MinHash.

Lines are compared by the sets of 8-byte shingles of their lower-case letters and digits. Signatures of BANDS * ROWS minima
are cut into bands; lines that agree in a whole band are candidates, verified by exact Jaccard similarity. Of each
connected component one line stays, the first by document id and line number. Equal lines, told by 128 bits, are one node from
the start, so boilerplate costs no pairs. For verification each candidate line is read where it was first seen; no text is shuffled to find it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE, U, Routed, fresh, lists, mix, pieces, powers, ranges, signed, written
from .verify import candidates, confirmed

#: Bytes in a shingle; minima in a band and bands; Jaccard similarity from which lines are alike. At this threshold a pair is
#: found with a probability of 0.978, at 0.85 of 0.999.
SHINGLE, ROWS, BANDS, THRESHOLD = 8, 4, 10, 0.75
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_A = (mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, ROWS * BANDS + 1001, dtype=np.uint64)) >> U(32)).astype(np.uint32)
#: Digests that a task remembers, to spare repeated work on equal lines; it forgets all beyond.
_REMEMBER = 1 << 20
#: Band keys that a task sorts at once.
_SORT = 1 << 21


class Lines:
    """The lines of texts: kept bytes, each line's first and past-the-end kept byte, digest in two parts, text number and number."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [(t or "").lower().encode() for t in texts]
        buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        keep = _KEEP[buf]
        ends = np.flatnonzero(buf == 10)
        c = np.concatenate([[0], np.cumsum(keep)])
        self.kept = buf[keep]
        self.end = c[ends]
        self.start = np.concatenate([[0], self.end[:-1]])
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        n = np.searchsorted(ends, first)  # lines before each text
        self.text = np.repeat(np.arange(len(parts)), np.diff(n))
        self.number = np.arange(len(ends)) - n[self.text]
        some = self.end > self.start  # lines without letters and digits are left alone
        self.start, self.end, self.text, self.number = self.start[some], self.end[some], self.text[some], self.number[some]
        x = BYTE[self.kept]
        self.digest, self.second = ranges(x, self.start, self.end), ranges(x, self.start, self.end, 0xD1342543DE82EF95)

    def line(self, i: int) -> bytes:
        return self.kept[self.start[i] : self.end[i]].tobytes()


def _shingled(kept: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lines one after the other, and where each line's begin. A line shorter than a shingle has
    one, of all its bytes."""
    n = np.maximum(end - start - SHINGLE + 1, 1)
    first = np.cumsum(n) - n
    x = BYTE[kept]
    up, _ = powers(0x9E3779B97F4A7C15, 64)
    for w in (1, 2, 4):
        x = x[:-w] * up[w] + x[w:] if len(x) > w else x[:0]
    i = np.arange(n.sum()) + np.repeat(start - first, n)
    h = mix(x[np.minimum(i, max(len(x) - 1, 0))]) if len(x) else np.zeros(len(i), np.uint64)
    short = np.flatnonzero(end - start < SHINGLE)
    if len(short):
        h[first[short]] = ranges(BYTE[kept], start[short], end[short], 0x2545F4914F6CDD1D)
    return h, first


def sets(texts: list[str]) -> list[np.ndarray]:
    """texts are lines as Lines.line() gives them."""
    raw = [t.encode("utf-8", "surrogateescape") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size)
    h, first = _shingled(np.frombuffer(b"".join(raw), np.uint8), end - size, end)
    return [np.unique(x) for x in np.split(h, first[1:])]


def bands(x: Lines, which: np.ndarray) -> np.ndarray:
    """The band keys of some lines, one row each."""
    out = np.empty((len(which), BANDS), np.uint64)
    at = 0
    size = np.cumsum(x.end[which] - x.start[which])
    while at < len(which):  # in steps that fit the processor's cache
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 16), side="right")))
        h, first = _shingled(x.kept, x.start[which[at:to]], x.end[which[at:to]])
        h = (h >> U(32)).astype(np.uint32)
        v = np.empty_like(h)
        for b in range(BANDS):
            k = np.full(to - at, U(b + 1))
            for r in range(b * ROWS, b * ROWS + ROWS):
                np.multiply(h, _A[r], out=v)
                np.bitwise_xor(v, _B[r], out=v)
                k = mix(k * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, first))
            out[at:to, b] = k
        at = to
    return out


def _shared(batches, whole: bool):
    """(key, node): of the lines of one task that share a band key, the smallest; or, with whole, all where there are several."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in held]])
        nodes = np.concatenate([np.zeros(0, np.int64), *[x for _, x in held]])
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        head = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        if whole:
            lo = nodes[np.flatnonzero(head)][np.cumsum(head) - 1]
            other = keys[nodes != lo]  # sorted
            i = np.minimum(np.searchsorted(other, keys), max(len(other) - 1, 0))
            head = other[i] == keys if len(other) else np.zeros(len(keys), bool)
        return pa.RecordBatch.from_arrays([pa.array(keys[head]), pa.array(nodes[head])], ["key", "node"])

    for b in batches:
        bands = b.column(1)
        held.append((bands.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), np.diff(bands.offsets.to_numpy()))))
        size += len(held[-1][0])
        if size > _SORT:
            yield out()
            held, size = [], 0
    yield out()


def _heads(batches):
    return _shared(batches, False)


def _members(batches):
    return _shared(batches, True)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(comp, node, text) of the wanted lines, (comp, node, n1, n2, part, row), written. Every input partition is told which of its rows hold wanted
    lines; should partitions come out otherwise than before, the rest is looked for in all rows."""
    spark, kinds = rows.sparkSession, "comp long, node long, text string"

    def found(texts: list[str], of: dict) -> pa.RecordBatch:
        x = Lines(texts)
        got = {k: (*of[k], x.line(i).decode()) for i, k in enumerate(zip(signed(x.digest).tolist(), signed(x.second).tolist())) if k in of}
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got.values()], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["comp", "node", "text"])

    def mapped(route: Routed, whole: bool):
        def run(batches):
            mine, at = route.mine(), 0
            if mine is None:
                return
            of = {k[:2]: k[2:] for k in zip(*(mine.column(c).to_pylist() for c in ("n1", "n2", "comp", "node")))}
            wanted_rows = np.unique(mine.column("row").to_numpy())
            for b in batches:
                here = np.isin(np.arange(at, at + b.num_rows), wanted_rows) if not whole else np.ones(b.num_rows, bool)
                at += b.num_rows
                for x in pieces([b.filter(pa.array(here))], 0):
                    yield found(x.column(0).to_pylist(), of)

        return run

    texts = rows.select("text")
    got = written(texts.mapInArrow(mapped(Routed(spark, wanted, "places"), False), kinds), "texts")
    rest = wanted.join(got, "node", "left_anti")
    while not rest.isEmpty():  # every partition is told of all that is left, in rounds of bounded size
        some = written(rest.limit(_REMEMBER).crossJoin(F.broadcast(texts.select(F.spark_partition_id().alias("p")).distinct())).withColumn("part", F.col("p")).drop("p"), "rest")
        # written by itself: in a union its partitions would be numbered anew
        more = written(texts.mapInArrow(mapped(Routed(spark, some, "places"), True), kinds), "texts")
        if more.isEmpty():
            raise RuntimeError("lines are gone: the documents changed while they were read")
        got = written(got.unionByName(more), "texts")
        rest = wanted.join(got, "node", "left_anti")
    return got


def _lines(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, x, line_no, keep): the lines of the groups of two or more. x: a hash of the text; keep: the (id, line_no, x) that stays."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).dropna()

    def signatures(batches):
        known: set[int] = set()
        part, at = TaskContext.get().partitionId(), 0
        for b in pieces(batches, 1):
            x = Lines(b.column(1).to_pylist())
            new = []
            for i, k in enumerate((x.digest ^ mix(x.second)).tolist()):
                if k not in known:
                    known.add(k)
                    new.append(i)
            if len(known) > _REMEMBER:
                known.clear()
            new = np.array(new, np.int64)
            n = np.zeros(len(x.text), np.int64)
            n[new] = BANDS
            keys = lists(signed(bands(x, new).reshape(-1)) if len(new) else np.zeros(0, np.int64), n, pa.int64())
            own, place = pa.array(x.text), [pa.array(np.full(len(n), part, np.int32)), pa.array(x.text + at)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), pa.array(x.number, pa.int32()), pa.array(signed(x.digest)), pa.array(signed(x.second)), *place, keys], ["id", "x", "line_no", "n1", "n2", "part", "row", "bands"])
            at += b.num_rows

    kinds = "id long, x long, line_no int, n1 long, n2 long, part int, row long, bands array<long>"
    lines = written(rows.select("id", "text", F.xxhash64("text").alias("x")).mapInArrow(signatures, kinds), "lines")
    first = lines.where("size(bands) > 0")  # of each line in its part
    keyed = first.select("n1", "bands")
    near = W.partitionBy("key")  # a key has a row from each task, at most, whatever the number of its lines
    heads = keyed.mapInArrow(_heads, "key long, node long").withColumn("lo", F.min("node").over(near)).withColumn("hi", F.max("node").over(near)).where("lo <> hi").select("key", "node")
    buckets = written(heads.unionByName(keyed.mapInArrow(_members, "key long, node long")).distinct(), "buckets")
    # so far lines are told by 64 bits; from here on by 128, with numbers of their own
    wanted = first.select("n1", "n2", F.struct("part", "row").alias("at")).join(candidates(buckets).withColumnRenamed("node", "n1"), "n1").groupBy("n1", "n2", "comp").agg(F.min("at").alias("at"))
    wanted = written(wanted.select("comp", F.monotonically_increasing_id().alias("node"), "n1", "n2", "at.*"), "wanted")
    buckets = buckets.withColumnRenamed("node", "n1").join(wanted.select("n1", "node"), "n1").select("key", "node")

    roots = written(confirmed(_texts(rows, wanted), buckets, sets, threshold), "roots")
    of = [wanted.select(F.col("node").alias(n), F.col("n1").alias(f"{p}1"), F.col("n2").alias(f"{p}2")) for n, p in (("node", "n"), ("root", "g"))]
    roots = roots.join(of[0], "node").join(of[1], "root").select("n1", "n2", "g1", "g2")
    of = lines.select("id", "x", "line_no", "n1", "n2").join(roots, ["n1", "n2"], "left").select("id", "x", "line_no", F.coalesce("g1", "n1").alias("g1"), F.coalesce("g2", "n2").alias("g2"))
    row = F.struct("id", "line_no", "x")
    kept = of.groupBy("g1", "g2").agg(F.min(row).alias("keep"), F.max(row).alias("hi")).where("keep <> hi").drop("hi")
    return of.join(kept, ["g1", "g2"]).select("id", "x", "line_no", "keep", (row != F.col("keep")).alias("goes"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, line_no, keep_id, keep_line_no): every line that goes, counted from 0, and the line that stays for it.

    Lines without a letter or digit are left alone, and so are rows whose id or text is null; empty texts have no lines. Rows that repeat both id and text
    keep or lose the same lines; the lines of several texts under one id aren't told apart here, but are by keep_one. Of other columns, whatever their names, nothing depends. Ids must be
    integers. Lines are equal by 128 bits of their letters and digits. An empty table gives an empty one."""
    kid, kline = fresh([id_col, "line_no"], "keep_id"), "keep_line_no"
    out = _lines(docs, id_col, text_col, threshold).where("id <> keep.id or line_no <> keep.line_no")
    return out.select(F.col("id").alias(id_col), "line_no", F.col("keep.id").alias(kid), F.col("keep.line_no").alias(kline)).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the duplicate lines taken out of their texts; all rows and other columns stay as they are. Texts are told apart by their
    content, too, where an id repeats; rows that repeat both id and text are one document."""
    gone, i, x = (fresh(docs.columns, n) for n in ("_gone", "_id", "_x"))
    out = _lines(docs, id_col, text_col, threshold).where("goes").groupBy(F.col("id").alias(i), F.col("x").alias(x)).agg(F.collect_set("line_no").alias(gone))
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, n: ~F.array_contains(F.col(gone), n)), "\n")
    both = docs.join(out, (F.col(f"`{id_col}`").cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(x)), "left")
    return both.select(*[F.when(F.col(gone).isNull(), text).otherwise(kept).alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicates() of all documents."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
