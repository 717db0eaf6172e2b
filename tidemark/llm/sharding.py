"""Sharding by a k-d tree over metadata.

A node whose texts exceed the target is split at the weighted median, texts' bytes being the weights, of the metadata
dimension that is widest within it. The upper part of the tree is built level by level: each pass over the (narrow,
written) metadata gives one histogram for each open node, and histograms narrow down to the exact median, so the driver
holds a few numbers for each node and nothing for each row. Nodes of few enough rows are finished whole, each in one task.
Both ways build the same tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, written

#: Bytes of text in a shard, at most, wherever metadata can tell its rows apart; rows of a node from which it is finished in one task; buckets of a histogram.
TARGET, LOCAL_ROWS, BUCKETS = 64 << 20, 200_000, 1024

Node = dict  # dims: split dimension or -1, cut, left and right child; state of open nodes


def dimension(df: DataFrame, name: str) -> Column:
    """A column as whole numbers, null being below all others: numbers as they are (fractions are cut off), times by
    microseconds, all else by a hash of 31 bits, which keeps equal values together."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        x = c.cast("long")
    elif kind in ("float", "double") or kind.startswith("decimal"):
        x = F.when(F.isnan(c.cast("double")), F.lit(None)).otherwise(F.greatest(F.least(c.cast("double"), F.lit(2.0**52)), F.lit(-(2.0**52)))).cast("long")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        x = F.unix_micros(c.cast("timestamp"))
    else:
        x = F.pmod(F.xxhash64(c), F.lit(1 << 31))
        x = F.when(c.isNotNull(), x)
    return F.greatest(F.least(F.coalesce(x, F.lit(-(1 << 60))), F.lit(1 << 60)), F.lit(-(1 << 60)))


def median(values: np.ndarray, weights: np.ndarray) -> int:
    """The cut of a split: the smallest value at which the running weight reaches half of the total, or one less if
    that is the largest, so that neither side is empty."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], np.cumsum(weights[order])
    cut = int(v[np.searchsorted(w * 2, w[-1], side="left")])
    return cut - 1 if cut == int(v[-1]) else cut


def widest(low: np.ndarray, high: np.ndarray, whole: np.ndarray) -> int:
    """The dimension of the largest extent as a share of the whole table's; the first of equals; -1 if all are 0."""
    extent = (high - low).astype(float) / np.maximum(whole, 1)
    best = int(np.argmax(extent))
    return best if high[best] > low[best] else -1


def subtree(x: np.ndarray, weight: np.ndarray, whole: np.ndarray, target: int, path: str) -> np.ndarray:
    """The leaves' paths, for the rows of one node: x has a row for each."""
    out = np.empty(len(x), object)
    todo = [(np.arange(len(x)), path)]
    while todo:
        rows, p = todo.pop()
        d = widest(x[rows].min(0), x[rows].max(0), whole) if len(rows) and weight[rows].sum() > target else -1
        if d < 0:
            out[rows] = p
            continue
        left = x[rows, d] <= median(x[rows, d], weight[rows])
        todo += [(rows[left], p + "0"), (rows[~left], p + "1")]
    return out


class Tree:
    """The upper part: arrays of the nodes' split dimension (-1 for none), cut and first child, and their paths."""

    def __init__(self) -> None:
        self.dim, self.cut, self.child, self.path = [-1], [0], [0], [""]

    def split(self, node: int, dim: int, cut: int) -> tuple[int, int]:
        self.dim[node], self.cut[node], self.child[node] = dim, cut, len(self.dim)
        for side in "01":
            self.dim.append(-1)
            self.cut.append(0)
            self.child.append(0)
            self.path.append(self.path[node] + side)
        return self.child[node], self.child[node] + 1

    def frozen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim), np.array(self.cut, np.int64), np.array(self.child)


def descend(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    dim, cut, child = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[dim[at[rows]] >= 0]
        n = at[rows]
        at[rows] = child[n] + (x[rows, dim[n]] > cut[n])
    return at


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return np.stack([b.column(i).to_numpy() for i in range(k)], 1)


def _stats(meta: DataFrame, tree: Tree, k: int, fresh_nodes: set[int]) -> dict[int, tuple[int, int, np.ndarray, np.ndarray]]:
    """(rows, weight, lows, highs) of some nodes, by one pass."""
    frozen = meta.sparkSession.sparkContext.broadcast((tree.frozen(), np.array(sorted(fresh_nodes))))
    fields = "node long, n long, w long, " + ", ".join(f"l{i} long, h{i} long" for i in range(k))

    def run(batches):
        t, wanted = frozen.value
        for b in batches:
            x, w = _matrix(b, k), b.column(k).to_numpy()
            at = descend(t, x)
            ok = np.isin(at, wanted)
            at, x, w = at[ok], x[ok], w[ok]
            nodes, inv = np.unique(at, return_inverse=True)
            order = np.argsort(inv, kind="stable")
            first = np.searchsorted(inv[order], np.arange(len(nodes)))
            cols = [nodes, np.bincount(inv, minlength=len(nodes)), np.add.reduceat(w[order], first) if len(nodes) else w]
            for i in range(k):
                v = x[order, i]
                cols += [np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)] if len(nodes) else [v, v]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], [f.split()[0] for f in fields.split(", ")])

    names = [f"d{i}" for i in range(k)]
    parts = meta.select(*names, "w").mapInArrow(run, fields)
    total = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *[f(f"{c}{i}").alias(f"{c}{i}") for i in range(k) for c, f in (("l", F.min), ("h", F.max))])
    return {r["node"]: (r["n"], r["w"], np.array([r[f"l{i}"] for i in range(k)]), np.array([r[f"h{i}"] for i in range(k)])) for r in total.toLocalIterator()}


def _cuts(meta: DataFrame, tree: Tree, k: int, open_: dict[int, tuple[int, int, int, int]]) -> dict[int, int]:
    """The exact weighted medians of nodes, node -> (dim, low, high, weight): each pass narrows every interval to
    the bucket that holds its median."""
    low = {n: lo for n, (_, lo, _, _) in open_.items()}
    high = {n: hi for n, (_, _, hi, _) in open_.items()}
    before = dict.fromkeys(open_, 0)
    while pending := sorted(n for n in open_ if low[n] < high[n]):
        ids = np.array(pending)
        width = np.array([(high[n] - low[n]) // BUCKETS + 1 for n in pending], np.int64)
        shared = meta.sparkSession.sparkContext.broadcast((tree.frozen(), ids, np.array([open_[n][0] for n in pending]), np.array([low[n] for n in pending], np.int64), np.array([high[n] for n in pending], np.int64), width))

        def run(batches):
            t, ids, dim, lo, hi, width = shared.value
            for b in batches:
                x, w = _matrix(b, k), b.column(k).to_numpy()
                at = descend(t, x)
                i = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                ok = ids[i] == at
                i, x, w = i[ok], x[ok], w[ok]
                v = x[np.arange(len(x)), dim[i]]
                ok = (v >= lo[i]) & (v <= hi[i])
                i, v, w = i[ok], v[ok], w[ok]
                key, inv = np.unique(np.stack([ids[i], (v - lo[i]) // width[i]], 1), axis=0, return_inverse=True)
                sums = np.zeros(len(key), np.int64)
                np.add.at(sums, inv.reshape(-1), w)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sums)], ["node", "b", "w"])

        hist = meta.select(*[f"d{i}" for i in range(k)], "w").mapInArrow(run, "node long, b long, w long").groupBy("node", "b").agg(F.sum("w").alias("w"))
        state = meta.sparkSession.createDataFrame([(n, before[n], open_[n][3]) for n in pending], "node long, before long, total long")
        run_ = F.sum("w").over(W.partitionBy("node").orderBy("b"))
        at = hist.join(F.broadcast(state), "node").withColumn("upto", run_ + F.col("before")).where("upto * 2 >= total").groupBy("node").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("w")).alias("before")), "b").alias("x")).select("node", "x.*")
        for r in at.toLocalIterator():
            n = r["node"]
            step = (high[n] - low[n]) // BUCKETS + 1
            low[n], before[n] = low[n] + r["b"] * step, r["before"]
            high[n] = min(high[n], low[n] + step - 1)
    return {n: low[n] - (low[n] == open_[n][2]) for n in open_}


def shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"), id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(id, bytes, shard) for every row of docs. shard is the path from the root to the row's leaf, 0 for the lower
    side; a table within the target is one shard, the empty path. Shards of an ordered table are ranges of it.

    A leaf exceeds the target only if all its rows agree in every dimension, as repeated rows do: those stay together. Null texts
    weigh 0 bytes; null dimensions come before all others. Null ids and repeated rows are kept. An empty table gives no
    rows. Columns that aren't dimensions don't matter, whatever their names."""
    if not dims:
        raise ValueError("at least one dimension is needed")
    k, names = len(dims), [f"d{i}" for i in range(len(dims))]
    meta = written(docs.select(*[dimension(docs, c).alias(n) for c, n in zip(dims, names)], F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("w"), F.col(f"`{id_col}`").alias("id")), "metadata")
    tree, local, whole = Tree(), set(), np.zeros(k)
    new = {0}
    while new:
        open_ = {}
        for node, (n, w, lo, hi) in _stats(meta, tree, k, new).items():
            if node == 0:
                whole = (hi - lo).astype(float)
            d = widest(lo, hi, whole) if w > target else -1
            if d >= 0 and n <= local_rows:
                local.add(node)
            elif d >= 0:
                open_[node] = (d, int(lo[d]), int(hi[d]), w)
        new = set()
        for node, cut in _cuts(meta, tree, k, open_).items():
            new |= {*tree.split(node, open_[node][0], cut)}
    shared = docs.sparkSession.sparkContext.broadcast((tree.frozen(), np.array(sorted(local), np.int64), np.array(tree.path, object), whole))
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def top(batches):
        for b in batches:
            t, inner, paths, _ = shared.value
            at = descend(t, _matrix(b, k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.isin(at, inner)), pa.array(paths[at], pa.string())], [*b.schema.names, "inner", "shard"])

    schema = ", ".join(f"{n} long" for n in names) + f", w long, id {kind}, inner boolean, shard string"
    placed = meta.mapInArrow(top, schema)
    out = placed.where("not inner").select("id", "w", "shard")
    if local:

        def bottom(table: pa.Table) -> pa.Table:
            x = np.stack([table.column(n).to_numpy() for n in names], 1)
            paths = subtree(x, table.column("w").to_numpy(), shared.value[3], target, table.column("shard")[0].as_py())
            return pa.table([table.column("id").combine_chunks(), table.column("w").combine_chunks(), pa.array(paths, pa.string())], names=["id", "w", "shard"])

        out = out.unionByName(placed.where("inner").groupBy("shard").applyInArrow(bottom, f"id {kind}, w long, shard string"))
    return out.select(F.col("id").alias(fresh(["bytes", "shard"], id_col)), F.col("w").alias("bytes"), "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards() of all documents."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, documents, bytes) of shards of 256 kB, small enough to cut small tables."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), target=256 << 10).groupBy("shard").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))
