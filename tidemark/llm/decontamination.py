"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised to lower-case letters and digits with single blanks between words. An item of
length n occurs in a document with at most e edits only if they share at least n + 1 - q - q * e of its q-grams on
diagonals that are at most e apart, so within one of the overlapping bands of diagonals. Shared
q-grams are counted by band; the regions that reach the bound are verified by banded alignment. The filter loses
nothing: what it drops can't be within the edit budget. Items shorter than a gram may have no edits and are searched for as they are, between
word boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix, pieces, powers, written

#: Characters in a gram, edits as a share of an item's length, and bytes of benchmark text searched for in one pass; its index has some 25 times
#: the bytes of its text.
Q, RATE, PASS_BYTES = 8, 0.1, 4 << 20
_TOP = 1 << 16
_lower = np.arange(_TOP, dtype=np.uint32)
_solid = np.ones(_TOP, bool)
for _i in range(_TOP):
    if not 0xD800 <= _i < 0xE000:
        _c = chr(_i)
        _solid[_i] = _c.isalnum()
        _l = _c.lower()
        if len(_l) == 1:
            _lower[_i] = ord(_l)


#: The normalised character of each, 32 for those that separate words.
_NORMAL = np.where(_solid, _lower, 32).astype(np.uint32)


#: Scripts that put no blanks between words: first and last code points. Each of their characters is a word.
UNSPACED = np.array([
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
])


def boundaries(a: np.ndarray) -> np.ndarray:
    """For each of the len(a) + 1 places in normalised characters whether a word may begin or end there."""
    i = np.searchsorted(UNSPACED[:, 0], a, side="right") - 1
    free = (a == 32) | ((i >= 0) & (a <= UNSPACED[np.maximum(i, 0), 1]))
    edge = np.ones(len(a) + 1, bool)
    edge[1:-1] = free[1:] | free[:-1]
    return edge


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of a text as code points, and where each stands in it."""
    a = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where(a < _TOP, _NORMAL[np.minimum(a, _TOP - 1)], a) if len(a) and a.max() >= _TOP else _NORMAL[a]
    solid = out != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    out = out[at]
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def quick(a: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hashes of all q-grams of an array of code points, cheap to make, to look up which may be shared."""
    x, size = a.astype(np.uint32, copy=False), 1
    h = x
    while size * 2 <= q:
        h = h[:-size] * np.uint32(pow(_FACTOR, size, 1 << 32)) + h[size:]
        size *= 2
    while size < q:
        h = h[:-1] * np.uint32(_FACTOR) + x[size : size + len(h) - 1]
        size += 1
    return h * np.uint32(0x9E3779B1)


_FACTOR = 0x2C1B3C6D


def hashes(a: np.ndarray, at: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams of an array of code points at some places."""
    up, _ = powers(0x9E3779B97F4A7C15, 64)
    h = np.zeros(len(at), np.uint64)
    for j in range(q):
        h += a[at + j].astype(np.uint64) * up[j + 1]
    return mix(h)


def budget(n: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of n characters: its share, but never so many that the lemma's bound falls below 1."""
    return max(0, min(int(rate * n), (n - q) // q))


class Items:
    """Benchmark items with an index of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, rate: float = RATE) -> None:
        self.q, self.ids, self.chars = q, [], []
        brief: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in zip(ids, texts):
            a = normalised(t)[0]
            if len(a) >= q:
                self.ids.append(i)
                self.chars.append(a)
            elif len(a):
                brief.setdefault(len(a), []).append((i, a))
        #: For each length below q: the items' hashes, sorted, their numbers, which follow those of the others, and their characters.
        self.brief: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, x in brief.items():
            chars = np.stack([a for _, a in x])
            h = hashes(chars.ravel(), np.arange(len(x)) * n, n)
            order = np.argsort(h, kind="stable")
            self.brief.append((n, h[order], len(self.ids) + order, chars[order]))
            self.ids += [i for i, _ in x]
        self.n = np.array([len(a) for a in self.chars], np.int64)
        self.edits = np.array([budget(int(n), q, rate) for n in self.n], np.int64)
        self.bound = self.n + 1 - q - q * self.edits
        h = [hashes(a, np.arange(len(a) - q + 1), q) for a in self.chars]
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        pos = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in h]])
        h = np.concatenate([np.zeros(0, np.uint64), *h])
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order].astype(np.int32), pos[order].astype(np.int32)
        self.gram, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h))).astype(np.int32)
        self.first = self.first.astype(np.int32)
        self.bits = min(30, max(16, int(len(self.gram) * 16).bit_length()))
        self.may = np.zeros(1 << self.bits - 3, np.uint8)  # a bit each
        for a in self.chars:
            x = quick(a, q) >> np.uint32(32 - self.bits)
            np.bitwise_or.at(self.may, x >> np.uint32(3), np.uint8(1) << (x & np.uint32(7)).astype(np.uint8))

    def regions(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, lowest diagonal, highest diagonal) of the bands whose shared q-grams reach the bound, for a normalised
        text. A diagonal is a position in the text less one in the item."""
        none = (np.zeros(0, np.int64),) * 3
        if len(a) < self.q:
            return none
        x = quick(a, self.q) >> np.uint32(32 - self.bits)
        at = np.flatnonzero(self.may[x >> np.uint32(3)] >> (x & np.uint32(7)).astype(np.uint8) & np.uint8(1))
        if not len(at):
            return none
        h = hashes(a, at, self.q)
        g = np.searchsorted(self.gram, h)
        g[g == len(self.gram)] = 0
        hit = self.gram[g] == h
        at, g = at[hit], g[hit]
        if not len(at):
            return none
        c = self.count[g]
        which = np.repeat(self.first[g], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        item, pos = self.item[which].astype(np.int64), self.pos[which].astype(np.int64)
        diag = np.repeat(at, c) - pos
        some = np.bincount(item)[item] >= self.bound[item]  # fewer in the whole text: fewer in any band
        if not some.any():
            return none
        item, pos, diag = item[some], pos[some], diag[some]
        # bands of 2e + 1 diagonals that begin every e + 1: any e + 1 neighbouring diagonals lie whole in one of them
        step = self.edits[item] + 1
        band = np.floor_divide(diag, step)
        keys = np.concatenate([np.stack([item, band, pos], 1), np.stack([item, band - 1, pos], 1)])
        keys = np.unique(keys, axis=0) if len(keys) < 64 else _rows(keys)  # an item's gram counts once a band
        new = np.flatnonzero(np.append(True, (keys[1:, :2] != keys[:-1, :2]).any(1)))
        n = np.diff(np.append(new, len(keys)))
        ok = n >= self.bound[keys[new, 0]]
        item, band = keys[new, 0][ok], keys[new, 1][ok]
        step = self.edits[item] + 1
        if not len(item):
            return none
        join = (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1)  # neighbours overlap: they are one region
        first, last = np.append(True, ~join), np.append(~join, True)
        return item[first], (band * step)[first], (band * step + 2 * step - 1)[last]


    def shorter(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, past the end) of the first places of the items of fewer than q characters that occur between word boundaries."""
        out, edge = [], boundaries(a) if self.brief else None
        for n, gram, item, chars in self.brief:
            if len(a) < n:
                continue
            at = np.flatnonzero(edge[:-n] & edge[n:])
            h = hashes(a, at, n)
            order = np.argsort(h, kind="stable")
            lo, hi = (np.searchsorted(h[order], gram, side=x) for x in ("left", "right"))
            for k in np.flatnonzero(hi > lo).tolist():
                for s in at[order[lo[k] : hi[k]]].tolist():
                    if (a[s : s + n] == chars[k]).all():
                        out.append((int(item[k]), s, s + n))
                        break
        return out


def _rows(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort(x.T[::-1])]
    return x[np.append(True, (x[1:] != x[:-1]).any(1))]


def nearest(a: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(edits, past the end) of the best place of a in a piece of text, the earliest of the best ends, if it needs at
    most `most` edits. All of a column of the alignment is in the bits of one number."""
    n = len(a)
    full, top, peq = (1 << n) - 1, 1 << (n - 1), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, d, best = full, 0, n, (most + 1, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        zero = ((((eq & up) + up) ^ up) | eq | down) & full
        hp, hn = down | (full & ~(zero | up)), up & zero
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | (full & ~(zero | hp)), hp & zero
        if d < best[0]:
            best = (d, j + 1)
    return best if best[0] <= most else None


def align(a: list[int], text: list[int], end: int, edits: int) -> tuple[int, int] | None:
    """(edits, first) of the best alignment of all of a that ends at `end` in text, in the band of diagonals that are at most `edits` from where it
    ends; None if it needs more edits. Of several the shortest stretch of text counts."""
    n, w, big = len(a), 2 * edits + 1, 1 << 30
    row = [j - edits if j >= edits else big for j in range(w)]  # from the end backwards
    for i in range(1, n + 1):
        new, c = [big] * w, a[n - i]
        for j in range(w):
            used = i + j - edits  # characters of text used by this cell
            if used < 0 or used > end:
                continue
            v = row[j] + (text[end - used] != c) if used else big
            if j + 1 < w and row[j + 1] + 1 < v:
                v = row[j + 1] + 1
            if j and new[j - 1] + 1 < v:
                v = new[j - 1] + 1
            new[j] = v
        row = new
    d = min(row)
    return (d, end - (n + row.index(d) - edits)) if d <= edits else None


def find(text: str | None, items: Items) -> list[tuple[int, int, int, int]]:
    """(item number, edits, first character, past the end) of every item found in a text, its best place each."""
    if not text or not items.ids:
        return []
    a, at = normalised(text)
    item, low, high = items.regions(a)
    out: dict[int, tuple[int, int, int]] = {}
    for i, lo, hi in zip(item.tolist(), low.tolist(), high.tolist()):
        most, n = int(items.edits[i]), int(items.n[i])
        lo = max(0, lo - most)
        piece, chars = a[lo : hi + n + most].tolist(), items.chars[i].tolist()
        got = nearest(chars, piece, most)
        if got:
            e, first = align(chars, piece, got[1], got[0])
            got = (e, lo + first, lo + got[1])
            if i not in out or got < out[i]:
                out[i] = got
    out |= {i: (0, s, t) for i, s, t in items.shorter(a)}
    return [(i, e, int(at[s]), int(at[t - 1]) + 1) for i, (e, s, t) in sorted(out.items())]


def passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", bytes_: int = PASS_BYTES, q: int = Q, rate: float = RATE):
    """The index of the benchmark, in parts of at most bytes_ of text, so that what goes to each task is bounded whatever
    the benchmark's size; each part is one more pass over the documents."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{text_col}`")).dropna().orderBy(F.col(f"`{item_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        if texts and size + len(r[1].encode()) > bytes_:
            yield Items(ids, texts, q, rate)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
    yield Items(ids, texts, q, rate)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", q: int = Q, rate: float = RATE, bytes_: int = PASS_BYTES, item_text_col: str = "text") -> DataFrame:
    """(id, item, edits, first_char, end_char) for each document and each benchmark item that occurs in it within
    rate * length edits, at its best place (fewest edits, then first).

    Null texts, null items and items without letters and digits match nothing. Items of fewer than q normalised characters match as whole words,
    without edits; in scripts without blanks each character is a word. Repeated rows of docs give repeated results;
    an id that is null is passed on; items without an id are left out. Repeated benchmark items give one result each. An empty table on either side gives an empty one. Of other columns nothing
    depends; an id or item column called as one of the results is renamed."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out, shared = None, None
    for items in passes(benchmark, item_col, item_text_col, bytes_, q, rate):
        if shared is not None:  # one index at a time
            out = written(out, "matches")
            shared.destroy()
        shared = sc.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for b in pieces(batches, 1):
                got = [(d, items.ids[i], e, s, t) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, e, s, t in find(x, items)]
                cols = list(zip(*got)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["id", "item", "edits", "first_char", "end_char"])

        part = rows.mapInArrow(run, "id long, item long, edits int, first_char long, end_char long")
        out = part if out is None else out.unionByName(part)
    doc = fresh(["edits", "first_char", "end_char"], id_col)
    return out.toDF(doc, fresh([doc, "edits", "first_char", "end_char"], item_col), "edits", "first_char", "end_char")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", q: int = Q, rate: float = RATE, bytes_: int = PASS_BYTES, item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item occurs; null texts stay."""
    sc, names = docs.sparkSession.sparkContext, docs.columns
    flag = fresh(names, "_clean")
    for items in passes(benchmark, item_col, item_text_col, bytes_, q, rate):
        clean = _clean(sc.broadcast(items))(F.col(f"`{text_col}`"))
        docs = docs.withColumn(flag, clean).where(F.col(flag)).select(*[F.col(f"`{n}`") for n in names])
    return docs


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        items = shared.value
        return pa.array([not find(t.as_py(), items) for t in texts], pa.bool_())

    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matches() of all documents and all benchmark items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
