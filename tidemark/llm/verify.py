"""Exact Jaccard verification of candidates, and the components of what it confirms.

Candidates are buckets: each holds the nodes that may be alike. A pair of nodes is an edge if the exact Jaccard
similarity of their sets reaches the threshold. Candidate components are small, so each is brought to one place
with its texts. There one node after the other is compared with all nodes that are still open, by counting along inverted
lists of set members; what it links is closed, so a group of n copies costs one comparison of n, and no pair is ever made. Components whose texts are too large for a
task's memory go bucket by bucket, and buckets that are too large themselves by pairs of blocks of their nodes; what these find is united by
distributed components. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, pieces, written
from .components import components

#: Bytes of text in a candidate component beyond which it is verified in parts.
LARGE = 64 << 20

Sets = Callable[[list[str]], list[np.ndarray]]


def linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set (arrays without repeats) the number of the first set of its component; an edge is a Jaccard similarity of `least` or
    more. An empty set is alone."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    root, open_ = np.arange(n), np.ones(n, bool)
    _, at = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    count = np.bincount(at)
    first = np.cumsum(count) - count
    holder = np.repeat(np.arange(n), size)[np.argsort(at, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(size)])
    left = n
    for s in range(n):
        if not open_[s]:
            continue
        open_[s], todo = False, [s]
        left -= 1
        for x in todo:  # grows as nodes are linked
            if not left:
                break
            member = at[begin[x] : begin[x + 1]]
            c = count[member]
            i = np.repeat(first[member] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            k = np.bincount(holder[i], minlength=n)
            new = np.flatnonzero(open_ & (k > 0) & (k >= least * (size[x] + size - k) - 1e-9))
            open_[new], root[new] = False, s
            left -= len(new)
            todo += new.tolist()
    return root


def _groups(sets: Sets, least: float):
    """(g, node, text), one group after the other, to (node, root) of the nodes but the first of each confirmed component."""

    def found(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.array(sorted(held), np.int64)
        root = linked([held[x] for x in nodes.tolist()], least) if len(nodes) > 1 else np.arange(len(nodes))
        moved = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])

    def run(batches):
        now, held = None, {}
        for b in pieces(batches, 2):
            for g, x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sets(b.column(2).to_pylist())):
                if g != now:
                    yield found(held)
                    now, held = g, {}
                held.setdefault(x, s)
        yield found(held)

    return run


def _in_groups(rows: DataFrame, sets: Sets, least: float) -> DataFrame:
    return rows.select("g", "node", "text").repartition("g").sortWithinPartitions("g", "node").mapInArrow(_groups(sets, least), "node long, root long")


def _in_parts(rows: DataFrame, buckets: DataFrame, sets: Sets, least: float, large: int) -> DataFrame:
    """The same for components that don't fit a task: rows (node, text), buckets (key, node)."""
    rows = written(rows.dropDuplicates(["node"]), "large")
    held = buckets.join(rows.select("node", F.octet_length("text").alias("n")), "node")
    blocks = held.groupBy("key").agg(F.when(F.sum("n") > large, F.ceil(F.sum("n") * 2 / large)).otherwise(1).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    with_ = held.join(blocks, "key").select("key", "node", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    g = with_.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node")
    return components(_in_groups(g.join(rows, "node"), sets, least))


def candidates(buckets: DataFrame) -> DataFrame:
    """(node, comp): the components of the nodes that share buckets, written; buckets: (key, node), written."""
    star = buckets.groupBy("key").agg(F.min("node").alias("m")).join(buckets, "key").where("node <> m").select("m", "node")
    linked_ = components(star)
    comp = linked_.unionByName(linked_.select(F.col("root").alias("node"), "root").distinct())
    return written(comp.withColumnRenamed("root", "comp"), "candidates")


def confirmed(texts: DataFrame, buckets: DataFrame, sets: Sets, least: float, large: int = LARGE) -> DataFrame:
    """(node, root) for the nodes of the verified components but their smallest, which is root. texts: (comp, node, text), written, repeats
    allowed. sets: texts to arrays of distinct hashes."""
    sizes = texts.groupBy("comp").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > large).select("comp")
    big = written(sizes, "large")
    some = not big.isEmpty()
    rows = texts.join(big, "comp", "left_anti") if some else texts
    out = _in_groups(rows.withColumnRenamed("comp", "g"), sets, least)
    if some:
        out = out.unionByName(_in_parts(texts.join(big, "comp", "left_semi").select("node", "text"), buckets, sets, least, large))
    return out


def verified(buckets: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Sets, least: float, large: int = LARGE) -> DataFrame:
    """candidates() and confirmed() in one. texts: from (node, comp) to (comp, node, text)."""
    return confirmed(written(texts(candidates(buckets)), "texts"), buckets, sets, least, large)


def positive(h: np.ndarray) -> np.ndarray:
    """63 bits, so that signed and unsigned order are the same."""
    return (h >> U(1)).view(np.int64)
