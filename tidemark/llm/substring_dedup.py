"""Substring dedup by prefix-partitioned suffix trees.

Texts are sequences of words, as white space separates them. Every passage of LEAST words or more that occurs twice is found:

1. A repeat of LEAST words has LEAST - GRAM + 1 grams of GRAM words, and the smallest of their hashes is the same at both places. Only such
   minima are counted over the corpus; suffixes whose first LEAST words have a minimum that occurs once are dropped.
2. The others are classed by their first LEAST words. A suffix can only begin a repeat that isn't part of a longer one
   where its class has different words before it, and subtrees can only branch where a class has different words after it; only these places go on.
3. Suffixes are split by prefix into groups that fit a task's memory: the prefixes whose first occurrence is in the same document share a group, so
   that a stretch of text goes to few of them; a group that is too large is split by prefix.
4. In a group each prefix has its subtree, compacted to the branching places. Its internal nodes are repeats of LEAST words or more; for each suffix the
   deepest one that has an earlier occurrence, and the deepest one of which it is the first occurrence itself, are kept, and of
   those the ones that are in no other of their document.
5. The subtree of a prefix that has too many suffixes for a task (runs of one word, say) is halved by depth: below the middle depth each set of suffixes that share
   as much is a part; above it the first of each set stands for the set. Parts are halved again until each fits a task, so
   there are as many rounds as the depth has binary digits, at most, however deep the subtree is; a round has less than two rows a suffix.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Routed, U, Words, discard, fresh, grams, lists, mix, pieces, powers, signed, written

#: Words in a repeat, at least; words in a gram; suffixes in a group, about.
LEAST, GRAM, GROUP = 50, 25, 200_000


def minima(g: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring values."""
    if len(g) < width:
        return g[:0]
    size = 1
    while size * 2 <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (width - size)], g[width - size :]) if width > size else g


def _docs(texts: list[str], least: int, gram: int):
    """(number, word hashes, gram hashes, minimum of each suffix's first `least` words) of the texts that are long enough."""
    w = Words(texts, plain=True)
    all_ = grams(w.hash, gram)
    for k, (a, b) in enumerate(zip(w.doc[:-1], w.doc[1:])):
        if b - a >= least:
            g = all_[a : b - gram + 1]
            yield k, w.hash[a:b], g, minima(g, least - gram + 1)


#: Hashes that a task gathers before it passes them on, each once.
_GATHER = 1 << 20


def _seen(ids: np.ndarray, size: np.ndarray) -> int:
    """A checksum of some rows, the sum of which tells whether a partition holds the same rows again."""
    return int(mix(ids * U(0x9E3779B97F4A7C15) + size.astype(np.uint64)).sum(dtype=np.uint64))


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, list[str], int]:
    ids, texts = b.column(0).to_numpy().view(np.uint64), b.column(1).to_pylist()
    return ids, texts, _seen(ids, np.array([len(t) for t in texts], np.int64))


def _prints(least: int, gram: int):
    """(v, n, part): the grams that are the minimum of some suffix, with their places in a partition; and, with n = 0, the partition's checksum."""
    width = least - gram + 1
    edge = np.zeros(width - 1, np.uint64)

    def run(batches):
        part, held, size, total = TaskContext.get().partitionId(), [], 0, 0

        def out(v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(v)), pa.array(n.astype(np.int32)), pa.array(np.full(len(v), part, np.int32))], ["v", "n", "part"])

        for b in pieces(batches, 1):
            _, texts, sum_ = _rows(b)
            total = total + sum_ & 0xFFFFFFFFFFFFFFFF
            for _, _, g, m in _docs(texts, least, gram):
                held.append(g[g == ~minima(~np.concatenate([edge, m, edge]), width)])  # the largest minimum around
                size += len(held[-1])
            if size > _GATHER:
                yield out(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield out(*np.unique(np.concatenate(held), return_counts=True))
        yield out(np.array([total], np.uint64), np.zeros(1))

    return run


#: What the second reading says if partitions don't hold the rows they held in the first.
_OTHERWISE = "partitions came out otherwise than in the first reading"


def _suffixes(route: Routed, least: int, gram: int):
    """The suffixes whose first `least` words have a minimum that occurs twice in the corpus."""

    def run(batches):
        mine, total = route.mine(), 0
        n = mine.column("n").to_numpy() if mine is not None else np.zeros(0, np.int32)
        v = mine.column("v").to_numpy() if mine is not None else np.zeros(0, np.int64)
        want, shared = set(v[n == 0].view(np.uint64).tolist()), np.sort(v[n > 0].view(np.uint64))
        for b in pieces(batches, 1):
            ids, texts, sum_ = _rows(b)
            total = total + sum_ & 0xFFFFFFFFFFFFFFFF
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(4)]
            for k, h, _, m in _docs(texts, least, gram) if len(shared) else ():
                new = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                may = shared[np.minimum(np.searchsorted(shared, m[new]), len(shared) - 1)] == m[new]
                i = np.flatnonzero(np.repeat(may, np.diff(np.append(new, len(m)))))
                if not len(i):
                    continue
                tag = grams(h, len(h))[0] >> U(33)  # tells texts under the same id apart
                own = mix(ids[k : k + 1] * U(0x9E3779B97F4A7C15) + tag) >> U(32)  # before the first word and after the last
                word = h >> U(32)
                before, after = np.concatenate([own, word[:-1]])[i], np.concatenate([word[least:], own])[i]
                for c, x in zip(cols, (grams(h, least)[i], np.full(len(i), ids[k]), tag << U(32) | i.astype(np.uint64), after << U(32) | before)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(c))) for c in cols], ["h", "id", "at", "nb"])
        if total not in want and (total or want):
            raise RuntimeError(_OTHERWISE)

    return run


def _shared_suffixes(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """(h, id, at, nb) of the suffixes that may be repeats."""
    prints = rows.mapInArrow(_prints(least, gram), "v long, n int, part int")
    several = prints.withColumn("all", F.sum("n").over(W.partitionBy("v"))).where("all > 1 or n = 0").select("part", "v", "n")
    return rows.mapInArrow(_suffixes(Routed(rows.sparkSession, several, "prints"), least, gram), "h long, id long, at long, nb long")


def _branching(suffixes: DataFrame) -> DataFrame:
    """The suffixes at which something branches: l, different words before the class; r, different words after it; on,
    another suffix goes on with the same word; own, the first document of the class."""
    low = (1 << 32) - 1
    x = suffixes.repartition("h").select("h", "id", "at", F.shiftrightunsigned("nb", 32).alias("after"), F.col("nb").bitwiseAND(F.lit(low)).alias("before"), F.xxhash64("id", "at").alias("k"))
    by = W.partitionBy("h").orderBy("after").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    same = W.partitionBy("h", "after")
    x = x.select("h", "id", "at", "after", "before", "k", (F.min("before").over(by) < F.max("before").over(by)).alias("l"), (F.min("after").over(by) < F.max("after").over(by)).alias("r"), F.min("id").over(by).alias("own"))
    x = x.where("l or r").withColumn("on", F.min("k").over(same) < F.max("k").over(same))
    return x.select("h", "id", F.shiftright("at", 32).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit(low)).cast("int").alias("pos"), "before", "after", "l", "r", "on", "own")


_RUN = "part long, id long, tag int, start array<int>, h array<long>, branch array<int>, after array<long>, big boolean"


def _runs(batches):
    """Documents' stretches of repeated text, for each group that has suffixes of one: where those begin and their prefixes, and the branching
    places from there on with the words that follow them. Suffixes of large classes have one row a stretch, too."""
    rest = None
    names = [x.split()[0] for x in _RUN.split(", ")]

    def cut(t: pa.Table) -> pa.RecordBatch:
        i, tag, pos, l, r, on, h, after, part, big = (t.column(c).to_numpy() for c in ("id", "tag", "pos", "l", "r", "on", "h", "after", "part", "big"))
        keep = np.append(True, (i[1:] != i[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1])) if len(i) else np.zeros(0, bool)
        i, tag, pos, l, r, on, h, after, part, big = (x[keep] for x in (i, tag, pos, l, r, on, h, after, part, big))
        last = r & ~on
        if len(i):
            last |= np.append((i[1:] != i[:-1]) | (tag[1:] != tag[:-1]), True)
        ends = np.flatnonzero(last) + 1
        out: list[list] = [[] for _ in names]
        for a, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            mine = np.flatnonzero(l[a:e]) + a
            if not len(mine):
                continue
            b = np.flatnonzero(r[a:e]) + a
            large, mine = mine[big[mine]], mine[~big[mine]]
            for p, m, one in [*((p, mine[part[mine] == p], False) for p in np.unique(part[mine]).tolist()), *([(0, large, True)] if len(large) else [])]:
                s = b[np.searchsorted(b, m[0]) :]
                if len(s):
                    for c, v in zip(out, (p, int(i[a]), int(tag[a]), pos[m], h[m], pos[s], after[s], one)):
                        c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
        arrays = [lists(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64 if k == pa.int64() else np.int32), np.array([len(v) for v in c], np.int64), k) for c, k in zip(out[3:], kinds)]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *arrays, pa.array(out[7], pa.bool_())], names)

    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if t.num_rows < 1 << 16:
            rest = t
            continue
        i, tag = t.column("id").to_numpy(), t.column("tag").to_numpy()
        new = np.flatnonzero((i[1:] != i[:-1]) | (tag[1:] != tag[:-1])) + 1
        at = int(new[-1]) if len(new) else 0
        rest = t.slice(at)
        if at:
            yield cut(t.slice(0, at))
    if rest is not None:
        yield cut(rest)


def repeats(start: list[int], who: list[tuple[int, int]], seq: list[bytes], branch: list[np.ndarray], least: int):
    """The subtree of the suffixes that share a prefix of `least` words. start: where each begins; who: its (id, tag); seq: for each of its branching places, in order, four bytes for the word that
    follows; branch: those places. Gives (suffix, end, copies, first suffix) of, for each suffix, the deepest internal node with an earlier occurrence, and the deepest of which it is the first."""
    order = sorted(range(len(seq)), key=seq.__getitem__)
    n = len(order)
    place = [(*who[i], start[i]) for i in order]
    depth = [0] * (n + 1)  # of what a suffix shares with the one before it, in words
    for k in range(1, n):
        x, y = seq[order[k - 1]], seq[order[k]]
        m = min(len(x), len(y)) // 4
        differ = np.flatnonzero(np.frombuffer(x, np.uint32, m) != np.frombuffer(y, np.uint32, m))
        j = int(differ[0]) if len(differ) else m
        i = order[k]
        depth[k] = int(branch[i][j]) - start[i] + least if j < len(branch[i]) else int(branch[i][-1]) - start[i] + least
    # internal nodes are the intervals of neighbours that share as much; node 0 is above them all
    deep, lo, hi, parent, low, leaf, stack = [0], [0], [n], [-1], [-1], [0] * n, [0]

    def lower(x: int, k: int) -> None:
        if low[x] < 0 or place[k] < place[low[x]]:
            low[x] = k

    for k in range(1, n + 1):
        d, first, child = (depth[k] if k < n else 0), k - 1, -1
        if d <= deep[stack[-1]]:
            leaf[k - 1] = stack[-1]
            lower(stack[-1], k - 1)
        while deep[stack[-1]] > d:
            child = stack.pop()
            hi[child], first = k, lo[child]
            if deep[stack[-1]] >= d:
                parent[child] = stack[-1]
                lower(stack[-1], low[child])
        if deep[stack[-1]] < d:
            x = len(deep)
            for values, v in zip((deep, lo, hi, parent, low), (d, first, n, -1, -1)):
                values.append(v)
            stack.append(x)
            if child >= 0:
                parent[child] = x
                lower(x, low[child])
            else:
                leaf[k - 1] = x
                lower(x, k - 1)
    for k in range(n):
        x = leaf[k]
        if x and low[x] == k:
            yield order[k], start[order[k]] + deep[x], hi[x] - lo[x], order[k]
        while x > 0 and low[x] == k:
            x = parent[x]
        if x > 0:
            yield order[k], start[order[k]] + deep[x], hi[x] - lo[x], order[low[x]]


def halves(after: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, part: np.ndarray, low: np.ndarray, width: np.ndarray, copies: np.ndarray, deep: np.ndarray):
    """What repeats() gives, for parts of subtrees and without copies of the suffixes. after: words that follow branching places; at: where each suffix's first one is in it; size: how many it has;
    place: the suffixes' order. The suffixes of a part share `low` branching places and less than low + width, a power of two; each
    stands for `copies`, and is asked for what it is the first of if it is `deep`. Gives arrays (suffix, branching places shared, copies, first suffix), a row each."""
    up, down = powers(_BASE, len(after) + 1)
    sums = np.append(U(0), np.cumsum(after * up[: len(after)], dtype=np.uint64))
    part, left, now = part.view(np.uint64), int(width.max(initial=0)), None
    while left:
        new = np.flatnonzero(width == left)
        new = (new, part[new], low[new], copies[new], deep[new])
        i, p, lo, n, d = now = new if now is None else tuple(map(np.concatenate, zip(now, new)))
        if left == 1:
            break
        left //= 2
        has = size[i] >= lo + left
        x = np.flatnonzero(has)
        a = at[i[x]] + lo[x]
        v = mix(mix((sums[a + left] - sums[a]) * down[a] + U(left * _BASE & 0xFFFFFFFFFFFFFFFF)) + p[x] * U(0x9E3779B97F4A7C15))  # one for each part, width and what follows
        order = np.lexsort((place[i[x]], v))
        x, v = x[order], v[order]
        begin = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        many = np.diff(np.append(begin, len(v)))
        total = np.add.reduceat(n[x], begin) if len(v) else n[:0]
        set_ = many > 1
        below, lead = np.repeat(set_, many), x[begin[set_]]
        alone = np.concatenate([x[begin[~set_]], np.flatnonzero(~has)])
        y = x[below]
        now = (
            np.concatenate([i[y], i[alone], i[lead]]),
            np.concatenate([v[below], p[alone], p[lead]]),
            np.concatenate([lo[y] + left, lo[alone], lo[lead]]),
            np.concatenate([n[y], n[alone], total[set_]]),
            np.concatenate([d[y], d[alone], np.zeros(len(lead), bool)]),
        )
        _, which, count = np.unique(now[1], return_inverse=True, return_counts=True)
        now = tuple(c[count[which] > 1] for c in now)
    if now is None or not len(now[0]):
        return (np.zeros(0, np.int64),) * 4
    i, p, lo, n, d = now
    order = np.lexsort((place[i], p))  # all that is left of a part shares as much
    i, p, lo, n, d = (c[order] for c in (i, p, lo, n, d))
    begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    many = np.diff(np.append(begin, len(p)))
    keep = np.repeat(many > 1, many)
    keep[begin] = d[begin] & (many > 1)
    return i[keep], lo[keep], np.repeat(np.add.reduceat(n, begin), many)[keep], np.repeat(i[begin], many)[keep]


#: Base of the hashes of words that follow branching places. Suffixes at which subtrees are halved instead of sorted.
_BASE, _SORT = 0x9FB21C651E98DF25, 1000
_ITEM = "part long, lo int, width int, id long, tag int, run int, pos int, k int, m int, n long, deep boolean"


def _order(*columns: np.ndarray) -> np.ndarray:
    """Each row's number in the order of some columns."""
    out = np.empty(len(columns[0]), np.int64)
    out[np.lexsort(columns[::-1])] = np.arange(len(out))
    return out


def _table(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _items(width: int):
    """The suffixes of large classes from rows of _RUN; a part is a class. k: a suffix's first branching place among the stretch's, run; m: how many it has from there on."""

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7)]
            for r in range(b.num_rows):
                start, h, branch = (b.column(c)[r].values.to_numpy() for c in ("start", "h", "branch"))
                k = np.searchsorted(branch, start)
                some = k < len(branch)
                k, every = k[some], np.ones(int(some.sum()), np.int64)
                for c, x in zip(out, (h[some], every * b.column("id")[r].as_py(), every * b.column("tag")[r].as_py(), every * int(branch[0]), start[some], k, len(branch) - k)):
                    c.append(x)
            part, i, tag, first, pos, k, m = map(np.concatenate, out)
            one = np.ones(len(i), np.int64)
            yield _table(_ITEM, part, one * 0, one * width, i, tag, first, pos, k, m, one, one > 0)

    return run


def _beside(items: DataFrame, stretches: DataFrame, *order: str) -> DataFrame:
    """Both, each stretch followed by its suffixes."""
    both = items.withColumns({"branch": F.lit(None).cast("array<int>"), "after": F.lit(None).cast("array<long>")}).unionByName(stretches, allowMissingColumns=True)
    return both.repartition("id", "tag").sortWithinPartitions("id", "tag", "run", F.col("after").isNull(), *order)


def _walk(batches):
    """(branch, after, suffixes' rows) of _beside()'s rows, stretch by stretch; those of one that is in several batches come in several pieces."""
    branch = after = None
    for b in batches:
        at = np.flatnonzero(b.column("after").is_valid().to_numpy(zero_copy_only=False)).tolist()
        if (at[0] if at else b.num_rows) > 0:
            yield branch, after, b.slice(0, at[0] if at else b.num_rows)
        for x, y in pairwise([*at, b.num_rows]):
            branch, after = b.column("branch")[x].values.to_numpy(), b.column("after")[x].values.to_numpy().view(np.uint64)
            if y > x + 1:
                yield branch, after, b.slice(x + 1, y - x - 1)


def _hashed(half: int, least: int):
    """Suffixes with v, a hash of the `half` words that follow the branching places after what their part shares, null if they have fewer, and with stop, the end of what the part shares."""

    def run(batches):
        had = None
        for branch, after, t in _walk(batches):
            if had is not after:
                had, (up, down) = after, powers(_BASE, len(after) + 1)
                sums = np.append(U(0), np.cumsum(after * up[: len(after)], dtype=np.uint64))
            k, m, lo = (t.column(c).to_numpy().astype(np.int64) for c in ("k", "m", "lo"))
            has = m >= lo + half
            a = np.where(has, k + lo, 0)
            v = mix((sums[np.where(has, a + half, 0)] - sums[a]) * down[a] + U(half))
            stop = branch[k + np.minimum(lo, m - 1)] + least
            own = [t.column(f.split()[0]) for f in _ITEM.split(", ")]
            yield _table(f"{_ITEM}, v long, stop int", *own, pa.array(signed(v), pa.int64(), mask=~has), stop)

    return run


_PIECE = "part long, lo int, width int, id long, tag int, pos array<int>, k array<int>, m array<int>, n array<long>, deep array<int>, branch array<int>, after array<long>"


def _pieces_of(batches):
    """The suffixes of one part and stretch in a row, with the branching places that they need; k counts from the first of those."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in _PIECE.split(", ")]
    out: list[list] = [[] for _ in names]

    def batch() -> pa.RecordBatch:
        flat = [pa.array(c, k) for c, k in zip(out[:5], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
        arrays = [lists(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64 if k == pa.int64() else np.int32), np.array([len(v) for v in c], np.int64), k) for c, k in zip(out[5:], kinds)]
        return pa.RecordBatch.from_arrays([*flat, *arrays], names)

    held = 0
    for branch, after, t in _walk(batches):
        part, lo, width, pos, k, m, n, deep = (t.column(c).to_numpy(zero_copy_only=False) for c in ("part", "lo", "width", "pos", "k", "m", "n", "deep"))
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        i, tag = t.column("id")[0].as_py(), t.column("tag")[0].as_py()
        for x, y in pairwise([*begin, len(part)]):
            a = min(int(k[x:y].min()) + int(lo[x]), len(branch) - 1)
            e = min(int(k[x:y].max()) + int(lo[x]) + int(width[x]), len(branch))
            for c, value in zip(out, (int(part[x]), int(lo[x]), int(width[x]), i, tag, pos[x:y], k[x:y] - a, m[x:y], n[x:y], deep[x:y], branch[a:e], after[a:e].view(np.int64))):
                c.append(value)
            held += y - x + e - a
            if held > 1 << 18:
                yield batch()
                out, held = [[] for _ in names], 0
    yield batch()


def _parts(least: int, group: int):
    """What is found in parts that fit a task, from _PIECE rows in order of parts; small parts are taken together."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(x[5]) for x in rows])
        each = lambda c, kind=np.int64: np.repeat(np.array([x[c] for x in rows], kind), size)
        flat = lambda c, kind=np.int64: np.concatenate([x[c] for x in rows]).astype(kind)
        branch, after = flat(10), flat(11).view(np.uint64)
        base = np.repeat(np.cumsum([0, *(len(x[10]) for x in rows[:-1])]), size)
        part, lo, width, i, tag, pos, m = each(0), each(1), each(2), each(3), each(4), flat(5), flat(7)
        at = base + flat(6)
        s, shared, copies, first = halves(after, at, m, _order(i, tag, pos), part, lo, width, flat(8), flat(9, bool))
        return _table(_FOUND, i[s], tag[s], pos[s], branch[at[s] + np.minimum(shared, m[s] - 1)] + least, copies, i[first], pos[first])

    def run(batches):
        rows, now, held = [], None, 0
        for b in batches:
            c = [b.column(x) for x in range(b.num_columns)]
            for r in range(b.num_rows):
                part = c[0][r].as_py()
                if part != now and held > min(group, 1 << 19):
                    yield found(rows)
                    rows, held = [], 0
                now = part
                rows.append((*[c[x][r].as_py() for x in range(5)], *[c[x][r].values.to_numpy() for x in range(5, 12)]))
                held += len(rows[-1][5]) + len(rows[-1][10])
        if rows:
            yield found(rows)

    return run


def _extended(big: DataFrame, least: int, group: int) -> DataFrame:
    """What is found in classes of more than `group` suffixes, from their rows of _RUN: their subtrees are halved by depth until each part fits a task. Parts meet only in aggregations
    and in joins with one row a part or a set, so no task holds one."""
    place = F.struct("id", "tag", "pos", "run", "k", "m")
    stretches = big.select("id", "tag", F.col("branch")[0].alias("run"), "branch", "after")
    width = 1 << (big.agg(F.max(F.size("branch"))).first()[0] or 0).bit_length()
    names = [f.split()[0] for f in _ITEM.split(", ")]
    now, fit = written(big.mapInArrow(_items(width), _ITEM), "big"), None
    while width > 1 and not now.isEmpty():
        width //= 2
        x = written(_beside(now, stretches).mapInArrow(_hashed(width, least), f"{_ITEM}, v long, stop int").drop("stop").withColumn("width", F.lit(width)), "halved")
        sets = written(x.where("v is not null").groupBy("part", "v").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.first("lo").alias("lo"), F.min(place).alias("first")).where("c > 1"), "sets")
        below = F.col("c").isNotNull()
        y = x.join(sets.select("part", "v", "c"), ["part", "v"], "left")
        y = y.withColumns({"part": F.when(below, F.xxhash64("part", "v", F.lit(width))).otherwise(F.col("part")), "lo": F.when(below, F.col("lo") + width).otherwise(F.col("lo"))}).select(*names)
        lead = sets.select("part", "lo", F.lit(width).alias("width"), "first.*", F.col("total").alias("n"), F.lit(False).alias("deep")).select(*names)
        both = written(y.unionByName(lead), "halved")
        for df in (now, x, sets):
            discard(df)
        both = both.join(both.groupBy("part").agg(F.count("*").alias("c")), "part")
        small, now = both.where(f"c > 1 and c <= {group}").select(*names), written(both.where(f"c > {group}").select(*names), "big")
        fit = small if fit is None else fit.unionByName(small)
    fit = now.limit(0) if fit is None else fit
    found = _beside(fit, stretches, "part").mapInArrow(_pieces_of, _PIECE).repartition("part").sortWithinPartitions("part").mapInArrow(_parts(least, group), _FOUND)
    if now.isEmpty():
        return found
    nodes = now.groupBy("part").agg(F.sum("n").cast("int").alias("copies"), F.min(F.struct("id", "tag", "pos")).alias("first"))  # all that is left of a part shares as much
    own = F.struct("id", "tag", "pos") == F.col("first")
    last = _beside(now, stretches).mapInArrow(_hashed(0, least), f"{_ITEM}, v long, stop int").join(nodes, "part").where(~own | F.col("deep"))
    return found.unionByName(last.select("id", "tag", "pos", "stop", "copies", F.col("first.id").alias("keep_id"), F.col("first.pos").alias("keep_pos")))


_FOUND = "id long, tag int, pos int, stop int, copies int, keep_id long, keep_pos int"


def _trees(least: int):
    def group(rows: list[tuple]) -> list[tuple]:
        """rows: (id, tag, start, h, branch, after) of one group."""
        by: dict[int, list[tuple[int, int]]] = {}
        raw = [(x[5] & 0xFFFFFFFF).astype(">u4").tobytes() for x in rows]
        for r, x in enumerate(rows):
            for j, h in enumerate(x[3].tolist()):
                by.setdefault(h, []).append((r, j))
        out = []
        base = np.cumsum([0, *(len(x[4]) for x in rows)])
        words = [np.concatenate([x[c] for x in rows]) for c in (4, 5)] if max(map(len, by.values())) > _SORT else None
        for members in by.values():
            if len(members) > _SORT:
                r, j = np.array(members).T
                i, tag, pos = (np.array([f(x, y) for x, y in members], np.int64) for f in (lambda x, _: rows[x][0], lambda x, _: rows[x][1], lambda x, y: rows[x][2][y]))
                at = base[r] + np.array([np.searchsorted(rows[x][4], p) for x, p in zip(r.tolist(), pos.tolist())])
                m, one = base[r + 1] - at, np.ones(len(r), np.int64)
                s, shared, copies, first = halves(words[1].view(np.uint64), at, m, _order(i, tag, pos), one, one * 0, one << int(m.max()).bit_length(), one, one > 0)
                stop = words[0][at[s] + np.minimum(shared, m[s] - 1)] + least
                out += zip(*(c.tolist() for c in (i[s], tag[s], pos[s], stop, copies, i[first], pos[first])))
                continue
            start, who, seq, branch = [], [], [], []
            for r, j in members:
                i, tag, s, _, b, _ = rows[r]
                k = int(np.searchsorted(b, s[j]))
                start.append(int(s[j]))
                who.append((i, tag))
                seq.append(raw[r][4 * k :])
                branch.append(b[k:])
            for m, stop, copies, first in repeats(start, who, seq, branch, least):
                out.append((*who[m], start[m], stop, copies, who[first][0], start[first]))
        return out

    def run(batches):
        now, rows, held = None, [], []

        def batch():
            cols = list(zip(*held)) if held else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _FOUND.split(", ")])

        for b in batches:
            c = [b.column(i) for i in range(b.num_columns)]
            for r in range(b.num_rows):
                part = c[0][r].as_py()
                if part != now:
                    held += group(rows) if rows else []
                    now, rows = part, []
                    if len(held) > 1 << 15:
                        yield batch()
                        held = []
                rows.append((c[1][r].as_py(), c[2][r].as_py(), *[c[i][r].values.to_numpy() for i in range(3, 7)]))
        held += group(rows) if rows else []
        yield batch()

    return run


def _found(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int | None, group: int) -> DataFrame:
    """(id, tag, pos, stop, copies, keep_id, keep_pos, own): what spans() returns; tag: a hash of the text, which tells texts under one id apart."""
    gram = (least + 1) // 2 if gram is None else gram
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).dropna()
    try:
        at = written(_branching(_shared_suffixes(rows, least, gram)), "branching")
    except Exception as e:
        if _OTHERWISE not in str(e):
            raise
        at = written(_branching(_shared_suffixes(written(rows, "rows"), least, gram)), "branching")  # from files partitions come out as they did
    large = at.where("l").groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > group).select("own", F.ceil(F.col("n") / group).alias("parts"))
    part = F.when(F.col("parts").isNull(), F.xxhash64("own")).otherwise(F.xxhash64("own", F.pmod("h", F.col("parts"))))
    placed = at.join(large, "own", "left").select("id", "tag", "pos", "l", "r", "on", "h", "after", part.alias("part"), F.col("parts").isNotNull().alias("split"))
    big = written(placed.where("l and split").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group).select("h", F.lit(True).alias("big")), "large")
    some = not big.isEmpty()
    placed = (placed.join(big, "h", "left") if some else placed.withColumn("big", F.lit(False))).withColumn("big", F.coalesce("big", F.lit(False))).drop("split")
    runs = placed.repartition("id", "tag").sortWithinPartitions("id", "tag", "pos").mapInArrow(_runs, _RUN)
    more = None
    if some:
        runs = written(runs, "runs")
        more = _extended(runs.where("big").drop("big"), least, group)
        runs = runs.where("not big")
    found = runs.drop("big").repartition("part").sortWithinPartitions("part").mapInArrow(_trees(least), _FOUND)
    found = found if more is None else found.unionByName(more)
    own = (F.col("keep_id") == F.col("id")) & (F.col("keep_pos") == F.col("pos"))
    upto = F.max("stop").over(W.partitionBy("id", "tag", "own").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("own", own).withColumn("upto", upto).where("upto is null or stop > upto")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """(id, first_word, end_word, copies, keep_id, keep_first_word): stretches of documents, in words counted from 0, of `least` words or more that occur more
    than once. Where keep_id and keep_first_word are the row's own, the stretch is the first occurrence of what it holds,
    in order of ids and places; otherwise it goes, and those tell the first occurrence. copies counts all occurrences. The rows of
    one document that go are maximal: none lies in another; together they cover every word of it that is part of a
    passage with an earlier occurrence.

    Rows with a null id or text, and texts of fewer words, have no repeats; an empty table gives an empty one. Each character of a script without blanks is a word. Copies under one id count once. Words are compared by
    64 bits of the passages' hashes. Other columns don't matter, whatever their names. Ids must be integers."""
    out = _found(docs, id_col, text_col, least, gram, group)
    names = fresh(["first_word", "end_word", "copies", "keep_id", "keep_first_word"], id_col)
    return out.select(F.col("id").alias(names), F.col("pos").alias("first_word"), F.col("stop").alias("end_word"), "copies", "keep_id", F.col("keep_pos").alias("keep_first_word"))


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without some stretches of words, and the white space before each of them."""
    w = Words([text], plain=True)
    raw, at, out = w.parts[0], 0, []
    for a, b in sorted(cuts):
        b = min(b, len(w.start))
        lo, hi = (int(w.end[a - 1]) if a else 0), int(w.end[b - 1])
        if hi > at:
            out.append(raw[at : max(lo, at)])
            at = hi
    return b"".join([*out, raw[at:]]).decode()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with every passage of `least` words or more taken out of the texts but where it occurs first; all rows and
    other columns stay. Texts are told apart by their content, too, where an id repeats; rows that repeat both id and text are one document. Nulls stay as they are."""
    cuts, i, tag = (fresh(docs.columns, n) for n in ("_cuts", "_id", "_tag"))
    found = _found(docs, id_col, text_col, least, None, GROUP).where("not own").groupBy(F.col("id").alias(i), F.col("tag").alias(tag)).agg(F.collect_set(F.struct(F.col("pos").alias("a"), F.col("stop").alias("b"))).alias(cuts))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, where: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not c else without(t, [(x["a"], x["b"]) for x in c]) for t, c in zip(texts.to_pylist(), where.to_pylist())], pa.string())

    @F.arrow_udf("int")
    def tags(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h = Words([t], plain=True).hash
            out.append(int(grams(h, len(h))[0] >> U(33)) if len(h) >= least else None)
        return pa.array(out, pa.int32())

    both = docs.withColumn(tag + "_", tags(F.col(f"`{text_col}`"))).join(found, (F.col(f"`{id_col}`").cast("long") == F.col(i)) & (F.col(tag + "_") == F.col(tag)), "left")
    return both.select(*[cut(F.col(f"`{n}`"), F.col(cuts)).alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans() of all documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
