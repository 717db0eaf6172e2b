"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step replaces the edges by others with the same components: large-star links a node's larger neighbours to
the smallest node near it, small-star its smaller neighbours. Both keep the number of edges in bounds, and a
logarithmic number of rounds leaves stars. Nothing is gathered on the driver but one row of checksums a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for the nodes of the edges a-b that aren't the smallest of theirs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, root = len(a), np.arange(len(nodes))
    x, y = at[:n], at[n:]
    while len(x):
        hi, lo = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches):
    """Edges of one partition to a forest, in steps of bounded size; components stay the same."""
    a = b = np.zeros(0, np.int64)
    for x in batches:
        a = np.concatenate([a, x.column(0).to_numpy()])
        b = np.concatenate([b, x.column(1).to_numpy()])
        if len(a) > 1 << 19:
            a, b = forest(a, b)
            if len(a) > 1 << 18:  # a forest of many nodes: on with it
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (two long columns, either direction) but the roots; root is the
    smallest node of the component. Edges with a null end and loops are dropped; repeated edges don't matter; no
    edges give no rows."""
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e, last = written(e.mapInArrow(_local, "u long, v long"), "edges"), None
    while True:
        # large-star; edges go from the larger node u to the smaller v
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = W.partitionBy("u")
        star = both.withColumn("m", F.least("u", F.min("v").over(near))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star
        m = F.min("v").over(near)
        star = star.distinct().select("u", "v", m.alias("m")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(star, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
