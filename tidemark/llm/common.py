"""What the operators share: the shared folder, written intermediate tables, and NumPy kernels over text.

The kernels hash words and word n-grams of whole batches of texts at once: a polynomial hash modulo 2**64 over
bytes with a running sum, so that the hash of any word is two look-ups and a multiplication.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

_own: list[tuple[SparkSession, str]] = []


# --- the shared folder ---------------------------------------------------------------------------------------


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _own:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone, the folder is then the cluster's to expire
            pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, with its file system's scheme; deleted when this process ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}")
    path = p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).makeQualified(p).toString()
    _own.append((spark, path))
    return path


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Hadoop writes it, and the path in it, for Python tasks."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing will read it again."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tidemark-" in f:
            remove(df.sparkSession, f)


class Routed:
    """What each partition of an input is to know: a table with an int column `part`, in files cut by ranges of it. A task reads
    its own rows from the one or two files that hold them, so nothing is broadcast, however much there is."""

    def __init__(self, spark: SparkSession, df: DataFrame, what: str) -> None:
        self.path = scratch(spark, what)
        self.schema = df.schema
        df.repartitionByRange("part").sortWithinPartitions("part").write.option("parquet.block.size", 1 << 20).parquet(self.path)
        at = spark.read.schema(df.schema).parquet(self.path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
        self.files = [(r["lo"], r["hi"], r["file"]) for r in at.collect()]  # a row for each file

    def __getstate__(self) -> dict:
        return {"path": self.path, "files": self.files}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def mine(self) -> pa.Table | None:
        """The rows of the partition that this task works on; None if there are none."""
        part, found = TaskContext.get().partitionId(), []
        for lo, hi, name in self.files:
            if lo <= part <= hi:
                fs, root = opened(self.path)
                with fs.open_input_file(f"{root}/{name}") as f:
                    file = pq.ParquetFile(f)
                    at = file.schema_arrow.names.index("part")
                    for g in range(file.num_row_groups):
                        s = file.metadata.row_group(g).column(at).statistics
                        if s is None or not s.has_min_max or s.min <= part <= s.max:
                            t = file.read_row_group(g)
                            found.append(t.filter(pa.compute.equal(t.column("part"), part)))
        return pa.concat_tables(found).combine_chunks() if found and sum(map(len, found)) else None


def fresh(names: Iterable[str], base: str) -> str:
    """A column name that clashes with none of names (case doesn't count)."""
    have = {n.lower() for n in names}
    while base.lower() in have:
        base += "_"
    return base


# --- batches -------------------------------------------------------------------------------------------------


def pieces(batches: Iterable[pa.RecordBatch], text: int | None, limit: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of at most `rows` rows and about `limit` bytes of the column number `text`; a longer
    text is a slice of its own. No row is dropped."""
    for b in batches:
        n, at = b.num_rows, 0
        if text is None:
            size = np.zeros(n, np.int64)
        else:
            import pyarrow.compute as pc

            size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        while at < n:
            base = total[at - 1] if at else 0
            end = int(np.searchsorted(total, base + limit, side="right"))
            end = min(max(end, at + 1), at + rows, n)
            yield b.slice(at, end - at)
            at = end


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An array of lists from one flat array and the lists' lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- hashing -------------------------------------------------------------------------------------------------

U = np.uint64
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, out=p))
        have = _powers[base] = (out[0], out[1])
    return have


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The polynomial hash, mixed, of values[start:end] for each pair; equal content gives equal hashes wherever it
    lies."""
    n = len(values)
    up, down = powers(base, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


#: Scripts without blanks between words, as first and last UTF-8 bytes: Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo, Han, Yi.
_UNSPACED = [
    (b"\xe0\xb8\x80", b"\xe0\xbf\xbf"), (b"\xe1\x80\x80", b"\xe1\x82\x9f"), (b"\xe1\x9e\x80", b"\xe1\x9f\xbf"), (b"\xe3\x80\x85", b"\xe3\x80\x87"), (b"\xe3\x81\x80", b"\xe3\x84\xaf"), (b"\xe3\x86\xa0", b"\xe3\x86\xbf"),
    (b"\xe3\x87\xb0", b"\xe3\x87\xbf"), (b"\xe3\x90\x80", b"\xe9\xbf\xbf"), (b"\xea\x80\x80", b"\xea\x93\x8f"), (b"\xef\xa4\x80", b"\xef\xab\xbf"), (b"\xef\xbd\xa6", b"\xef\xbe\x9f"), (b"\xf0\x9b\x80", b"\xf0\x9b\x85"), (b"\xf0\xa0\x80", b"\xf0\xbf\xbf"),
]
_LOW, _HIGH = (np.array([int.from_bytes(x[i], "big") for x in _UNSPACED]) for i in (0, 1))


def unspaced(buf: np.ndarray) -> np.ndarray | None:
    """For UTF-8 bytes whether a character of such a script begins or has just ended at each of the len(buf) + 1 places; None if
    there is none."""
    lead = np.flatnonzero(buf[:-2] >= 0xE0) if len(buf) > 2 else np.zeros(0, np.int64)
    if not len(lead):
        return None
    x = buf[lead].astype(np.int64) << 16 | buf[lead + 1].astype(np.int64) << 8 | buf[lead + 2]
    i = np.searchsorted(_LOW, x, side="right") - 1
    lead = lead[(i >= 0) & (x <= _HIGH[np.maximum(i, 0)])]
    if not len(lead):
        return None
    out = np.zeros(len(buf) + 1, bool)
    out[lead] = True
    out[lead + np.where(buf[lead] >= 0xF0, 4, 3)] = True
    return out


class Words:
    """The words of several texts, one after the other: hash, first and past-the-end byte, and doc[i]:doc[i + 1] are
    the words of text i. plain: words are what white space ([ \\t\\n\\v\\f\\r]) separates, as they stand. Otherwise texts
    are lower-cased and words are runs of a-z, 0-9 and everything beyond ASCII. Each character of a script that puts no
    blanks between words is a word."""

    def __init__(self, texts: list[str | None], plain: bool = False) -> None:
        self.parts = [(t or "").encode() if plain else (t or "").lower().encode() for t in texts]
        table = _SPACE if plain else _BREAK
        buf = np.frombuffer(b"\n".join([*self.parts, b""]), np.uint8)
        size = np.fromiter((len(p) + 1 for p in self.parts), np.int64, len(self.parts))
        self.first = np.concatenate([[0], np.cumsum(size)])
        gap = np.empty(len(buf) + 2, bool)
        gap[0] = gap[-1] = True
        np.take(table, buf, out=gap[1:-1])
        single = unspaced(buf)
        if single is None:
            edge = np.flatnonzero(gap[1:] != gap[:-1])
            self.start, self.end = edge[::2], edge[1::2]
        else:
            self.start = np.flatnonzero(~gap[1:] & (gap[:-1] | single))
            self.end = np.flatnonzero(~gap[:-1] & (gap[1:] | single))
        h, at = np.empty(len(self.start), np.uint64), 0
        while at < len(h):  # in steps, to bound memory for one long text
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + _STEP, side="right")))
            lo, hi = self.start[at], self.end[to - 1]
            h[at:to] = ranges(BYTE[buf[lo:hi]], self.start[at:to] - lo, self.end[at:to] - lo)
            at = to
        self.hash = h
        self.doc = np.searchsorted(self.start, self.first)

    def byte(self, text: int, i: np.ndarray, end: bool = False) -> np.ndarray:
        """Bytes, in text number `text`, of words i."""
        return (self.end if end else self.start)[i] - self.first[text]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams h[i:i + n]; none if h is shorter."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    i = np.arange(len(h) - n + 1)
    return ranges(h, i, i + n, 0x2545F4914F6CDD1D)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
