"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts texts into chunks at places that depend on the bytes just before only, so copies and shared
passages give the same chunks wherever they stand. Chunks whose hash occurs more than once in the corpus are encoded
once each, by the first partition of the input that holds them. Their tokens go to the other partitions that hold them, so that hashes and tokens are shuffled,
texts never are; each partition puts its documents together from those tokens and its own for the text between. Then the joins
between chunks are repaired. A word that a cut went through has other tokens than its halves; the text around the join, between the
nearest places at which a pre-token begins in either context, is encoded again and replaces the tokens on both sides. The result is
exactly the encoding of the whole text. Tokens that a partition lacks, as when partitions come out differently a second time, it makes itself.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE, U, Routed, fresh, lists, mix, pieces, powers, ranges, signed, written

#: The rank file, the pattern of pre-tokens that belongs to it, the mean bytes of a chunk (a power of 2), the fewest, and
#: the bytes that the rolling hash sees.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEAN, LEAST, WINDOW = 256, 32, 16


@lru_cache(4)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- chunks ----------------------------------------------------------------------------------------------------


def cuts(buf: np.ndarray) -> np.ndarray:
    """Where chunks of one text begin, and its end. Cuts never fall within a character."""
    n = len(buf)
    if n <= LEAST:
        return np.array([0, n]) if n else np.zeros(1, np.int64)
    out, step = [0], 1 << 20
    for lo in range(0, n, step):  # in steps, to bound memory; each sees the window before it
        a = max(0, lo - WINDOW)
        x = BYTE[buf[a : min(n, lo + step)]]
        m = len(x) - WINDOW + 1
        if m < 1:
            continue
        up, down = powers(0x27BB2EE687B0B0FD, len(x) + 1)
        c = np.concatenate([[U(0)], np.cumsum(x * up[: len(x)], dtype=np.uint64)])
        h = mix((c[WINDOW:] - c[:-WINDOW]) * down[:m])
        for p in (np.flatnonzero((h & U(MEAN - 1)) == 0) + a + WINDOW).tolist():
            while p < n and buf[p] & 0xC0 == 0x80:
                p += 1
            if p - out[-1] >= LEAST and p < n:
                out.append(p)
    return np.array([*out, n])


def chunk_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    step, out, i = 1 << 20, [], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        out.append(ranges(BYTE[buf[at[i] : at[j]]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i], 0x5DEECE66D))
        i = j
    return np.concatenate([np.zeros(0, np.uint64), *out])


# --- repair ----------------------------------------------------------------------------------------------------


def _starts(b: bytes, last: bool) -> int:
    """The last (or first) place in b where white space follows an ASCII character that isn't: a pre-token begins there
    whatever stands before and after. -1 if there is none."""
    where = range(len(b) - 1, 0, -1) if last else range(1, len(b))
    for i in where:
        if b[i] in b" \n\t" and 33 <= b[i - 1] <= 126:
            return i
    return -1


def _reach(enc, tokens: list[int], last: bool) -> tuple[int, bytes]:
    """How many tokens at the end (beginning) of a list lie beyond its last (before its first) sure beginning of a
    pre-token, and their bytes; all of them if it has none."""
    m = 8
    while True:
        some = tokens[-m:] if last else tokens[:m]
        b = enc.decode_bytes(some)
        at = _starts(b, last)
        if at >= 0:
            size, want = 0, (len(b) - at if last else at)
            for i, t in enumerate(reversed(some) if last else some):
                if size == want:
                    return i, b[at:] if last else b[:at]
                size += len(enc.decode_single_token_bytes(t))
            if size == want:
                return len(some), b[at:] if last else b[:at]
        if m >= len(tokens):
            return len(tokens), enc.decode_bytes(tokens)
        m *= 2


def joined(enc, parts: list[list[int]]) -> list[int]:
    """The encoding of a text from the encodings of its parts, in order."""
    out: list[int] = []
    for part in parts:
        if not out or not part:
            out = out + part if not out else out
            continue
        n, a = _reach(enc, out, True)
        m, b = _reach(enc, part, False)
        del out[len(out) - n :]
        out += enc.encode_ordinary((a + b).decode())
        out += part[m:]
    return out


# --- encoding --------------------------------------------------------------------------------------------------


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


#: Hashes that a task gathers before it passes them on, each once.
_GATHER = 1 << 20


def _chunked(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a text, where its chunks begin, and its end, and their hashes."""
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    at = cuts(buf)
    return raw, at, chunk_hashes(buf, at)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids, n_tokens, round_trip) for every row of docs: the token ids of its text, their number, and whether decoding
    them gave the text's very bytes.

    A null text has null in all three; an empty one has no tokens. Repeated rows and null ids are kept. The
    strings of special tokens are ordinary text. An empty table gives an empty one. Of other columns, whatever their names, nothing depends. `vocabulary` must be readable
    on every executor. Ids must be integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def hashes(batches):
        part, held, size = TaskContext.get().partitionId(), [np.zeros(0, np.uint64)], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int32)), pa.array(np.full(len(h), part, np.int32))], ["h", "n", "part"])

        for b in pieces(batches, 0):
            new = [_chunked(t)[2] for t in b.column(0).to_pylist() if t]
            held += new
            size += sum(map(len, new))
            if size > _GATHER:
                yield out()
                held, size = [np.zeros(0, np.uint64)], 0
        yield out()

    texts = rows.select("text")
    of = W.partitionBy("h")  # a hash has a row or a few from each partition, at most
    held = texts.mapInArrow(hashes, "h long, n int, part int").select("h", "part", F.sum("n").over(of).alias("n"), F.min("part").over(of).alias("owner")).where("n > 1")
    held = written(held.select("h", "part", "owner").distinct(), "chunks")
    owned = Routed(spark, held.where("part = owner").select("part", "h"), "owned")

    def once(batches):
        enc, mine = encoding(vocabulary), owned.mine()
        if mine is None:
            return
        todo = np.sort(mine.column("h").to_numpy())
        new = np.ones(len(todo), bool)
        for b in pieces(batches, 0):
            h, keys, ids = [], [], []
            for t in b.column(0).to_pylist():
                if t:
                    raw, at, c = _chunked(t)
                    i = np.minimum(np.searchsorted(todo, signed(c)), len(todo) - 1)
                    for j in np.flatnonzero((todo[i] == signed(c)) & new[i]).tolist():
                        if new[i[j]]:
                            new[i[j]] = False
                            x = raw[at[j] : at[j + 1]]
                            h.append(int(todo[i[j]]))
                            keys.append(_key(x))
                            ids.append(enc.encode_to_numpy(x.decode(), disallowed_special=()))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(keys, pa.binary()), _lists(ids)], ["h", "key", "ids"])

    made = texts.mapInArrow(once, "h long, key binary, ids array<int>")
    codes = Routed(spark, held.select("h", "part").join(made, "h"), "codes")

    def assembled(batches):
        enc, mine = encoding(vocabulary), codes.mine()
        have = np.zeros(0, np.int64)
        if mine is not None:
            mine = mine.sort_by("h").combine_chunks()
            have, keys, ids = mine.column("h").to_numpy(), mine.column("key").combine_chunks(), mine.column("ids").combine_chunks()
            keys, flat, ends = keys.to_pylist(), ids.values.to_numpy(), ids.offsets.to_numpy()
        for b in pieces(batches, 1):
            out = []
            for t in b.column(1).to_pylist():
                if not t:
                    out.append(np.zeros(0, np.uint32))
                    continue
                if not len(have):
                    out.append(enc.encode_to_numpy(t, disallowed_special=()))
                    continue
                raw, at, c = _chunked(t)
                i = np.minimum(np.searchsorted(have, signed(c)), len(have) - 1)
                has = have[i] == signed(c)
                # equal hashes of other content fail here, and are encoded with the text between
                for j in np.flatnonzero(has).tolist():
                    has[j] = keys[i[j]] == _key(raw[at[j] : at[j + 1]])
                if not has.any():
                    out.append(enc.encode_to_numpy(t, disallowed_special=()))
                    continue
                parts, j = [], 0
                while j < len(has):
                    e = j + 1
                    if has[j]:
                        parts.append(flat[ends[i[j]] : ends[i[j] + 1]].tolist())
                    else:
                        while e < len(has) and not has[e]:
                            e += 1
                        parts.append(enc.encode_ordinary(raw[at[j] : at[e]].decode()))
                    j = e
                out.append(np.array(joined(enc, parts), np.uint32))
            texts = b.column(1).to_pylist()
            ok = [None if t is None else enc.decode_bytes(x.tolist()) == t.encode() for t, x in zip(texts, out)]
            yield _result(b.column(0).to_pylist(), out, ok, [t is None for t in texts])

    schema = "id long, ids array<int>, n_tokens int, round_trip boolean"
    return rows.mapInArrow(assembled, schema).withColumnRenamed("id", fresh(["ids", "n_tokens", "round_trip"], id_col))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return lists(np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32), np.array([len(x) for x in ids], np.int64), pa.int32())


def _result(i: list, ids: list[np.ndarray], ok: list, null: list[bool]) -> pa.RecordBatch:
    n = pa.array([None if z else len(x) for x, z in zip(ids, null)], pa.int32())
    x = _lists(ids)
    if any(null):
        x = pa.array([None if z else v for v, z in zip(x.to_pylist(), null)], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), x, n, pa.array(ok, pa.bool_())], ["id", "ids", "n_tokens", "round_trip"])


def decoded(vocabulary: str = VOCABULARY):
    """A column function: token ids -> text. Null gives null, no tokens the empty text."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        enc = encoding(vocabulary)
        return pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded() of all documents."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
