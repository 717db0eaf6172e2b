"""Dictionary-compressed WARC files: a writer and a reader.

A file is what the published .warc.zst layout asks for: a leading skippable frame (magic number 0x184D2A5D) with a Zstandard
dictionary, then each record as a frame of its own, so any record can be read by its offset. The dictionary of a
file is built from all records that go into it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, pieces, remove, scratch, written
from .common import opened as file_system

#: Bytes of records in a file before compression, about; bytes of a dictionary, at most; compression level.
FILE_BYTES, DICTIONARY, LEVEL = 64 << 20, 112_640, 6
MAGIC = 0x184D2A5D
#: COVER's length of a segment and of a counted substring.
_COVER = {"k": 512, "d": 8}


def header(name: str, url: str, size: int, digest: str, date: str) -> bytes:
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n").encode()


def clean(url: str | None) -> str:
    """A header can't hold line ends: they, and other control characters, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url or "")


def record(key: object, url: str | None, body: bytes, date: str) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}\n{url}\n{digest}")
    return header(str(name), clean(url), len(body), digest, date) + body + b"\r\n\r\n", digest


def dictionary(records: list[bytes], size: int = DICTIONARY) -> bytes:
    """Built from all the records by COVER; where they are too few or too small for it, of the first part of each, an eighth in all. Without
    records, or of size 0, it is empty."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), records, **_COVER).as_bytes() if size and records else b""
    except zstandard.ZstdError:
        share = min(size, max(64, total // 8)) // len(records) + 1
        return b"".join(r[:share] for r in reversed(records))[-size:]


def archive(records: list[bytes], level: int = LEVEL, size: int = DICTIONARY) -> Iterator[bytes]:
    """The frames of one file, the first one skippable."""
    d = dictionary(records, size)
    yield struct.pack("<II", MAGIC, len(d)) + d
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=True, write_checksum=True)
    for r in records:
        yield c.compress(r)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its header")
    return fields, rest[:n]


def opened(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with a file's dictionary, and where the first record is."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    d = data[8 : 8 + n]
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None), 8 + n


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a whole file."""
    z, at = opened(data)
    while at < len(data):
        d = z.decompressobj()
        raw = d.decompress(memoryview(data)[at:])
        size = len(data) - at - len(d.unused_data)
        yield at, size, raw
        at += size


_INDEX = "id {}, url string, file string, offset long, length long, raw_length long, digest string"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, level: int = LEVEL, size: int = DICTIONARY) -> DataFrame:
    """Writes every row of pages as a record into files in the folder `path`, and returns their index: (id, url, file,
    offset, length, raw_length, digest), digest being the SHA-1 of the body in base 32.

    A file's name follows from its partition, and it is put in place by renaming, so a task that runs again replaces what it wrote. A null body is
    written as an empty one, a null url as none; both null ids and repeated rows are kept. An empty table gives an empty index and no file. A folder that already holds
    WARC files raises ValueError. A body
    above file_bytes has a file of its own. Other columns aren't archived, whatever their names. The rows of pages must come in the same partitions when a task is
    repeated, as they do from files."""
    spark, p = pages.sparkSession, pages.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/*.warc.zst")
    if spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(p).size():
        raise ValueError(f"{path} holds WARC files already")
    kind = pages.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{body_col}`").alias("body"))

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        kept, raw, held, n = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, raw, held, n
            name = f"part-{t.partitionId():06d}-{n:05d}.warc.zst"
            trial = f"{root}/.{name}-{t.taskAttemptId()}"
            at, offsets, sizes = 0, [], []
            with fs.open_output_stream(trial, compression=None) as out:
                for i, frame in enumerate(archive(raw, level, size)):
                    out.write(frame)
                    if i:
                        offsets.append(at)
                        sizes.append(len(frame))
                    at += len(frame)
            if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound and not isinstance(fs, pafs.LocalFileSystem):
                fs.delete_file(f"{root}/{name}")
            fs.move(trial, f"{root}/{name}")
            cols = [[k[0] for k in kept], [k[1] for k in kept], [name] * len(raw), offsets, sizes, [len(r) for r in raw], [k[2] for k in kept]]
            kept, raw, held, n = [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (id_type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "url", "file", "offset", "length", "raw_length", "digest"])

        id_type = None
        for b in pieces(batches, 2):
            id_type = b.schema.field(0).type
            for i, u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                body = b"" if x is None else x if isinstance(x, bytes) else x.encode()
                r, digest = record(i, u, body, date)
                if raw and held + len(r) > file_bytes:
                    yield flush()
                kept.append((i, u, digest))
                raw.append(r)
                held += len(r)
        if raw:
            yield flush()

    index = written(rows.mapInArrow(run, _INDEX.format(kind)), "warc-index")
    names = [fresh(["url", "file", "offset", "length", "raw_length", "digest"], id_col), *index.columns[1:]]
    return index.toDF(*names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, body, digest, intact) of every record in the .warc.zst files of a folder; a url that is empty is null. intact: whether the body has the
    digest that its header gives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")

    def run(batches):
        for b in pieces(batches, 1, rows=1):
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for at, n, raw in records(data):
                    f, body = parse(raw)
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    rows.append((name.rsplit("/", 1)[-1], at, n, f["warc-target-uri"] or None, body, digest, f["warc-payload-digest"] == f"sha1:{digest}"))
                    size += len(raw)
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return files.mapInArrow(run, "file string, offset long, length long, url string, body binary, digest string, intact boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "offset", "length", "url", "body", "digest", "intact"])


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The index of an archive of all pages, with round_trip: whether the record that is read back from its place has the digest of the body
    that went in. Without a path the archive goes to the shared folder and is deleted once it is read."""
    spark = pages.sparkSession
    to = path or scratch(spark, "warc")
    index = write(pages, to, id_col, url_col, body_col)
    if index.isEmpty():
        return index.withColumn("round_trip", F.lit(True))
    back = read(spark, to).select("file", "offset", F.col("digest").alias("_digest"), "intact")
    out = index.join(back, ["file", "offset"], "left").withColumn("round_trip", F.coalesce(F.col("intact") & (F.col("digest") == F.col("_digest")), F.lit(False)))
    out = out.select(*index.columns, "round_trip")
    if path is None:
        out = written(out, "warc-checked")
        remove(spark, to)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip() of all pages."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
