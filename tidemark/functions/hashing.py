"""A seeded family of universal hash functions, and MurmurHash3 where its very values are wanted."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 4_294_967_311
#: small() hashes to numbers below this.
LARGEST = 2_147_483_640


def family(n: int, prime: int = PRIME, seed: int = 42) -> list[tuple[int, int, int]]:
    """(i, a, b) of n functions (a * x + b) mod prime; the first of a longer family are those of a shorter one."""
    r = random.Random(seed)
    return [(i, r.randint(1, prime - 1), r.randint(0, prime - 1)) for i in range(n)]


def family_table(spark: SparkSession, n: int, prime: int = PRIME, seed: int = 42) -> DataFrame:
    return spark.createDataFrame(family(n, prime, seed), "i int, a long, b long")


def universal(item: Column, prime: int = PRIME) -> Column:
    """The hash of an item by the function in columns a and b. Never negative, for negative items too. Any 64-bit item will do: it is
    multiplied in two halves, so nothing overflows for primes below 2**33."""
    x, p = F.pmod(item, F.lit(prime)), F.lit(prime)
    high = F.pmod(F.col("a") * F.shiftright(x, 16), p)
    return F.pmod(high * 65536 + F.col("a") * x.bitwiseAND(F.lit(65535)) + F.col("b"), p)


def universals(n: int, prime: int = PRIME) -> Callable[[np.ndarray], np.ndarray]:
    """universal() for n functions at once: of whole numbers from 0 to prime - 1 the hashes, unsigned, as (items, n)."""
    _, a, b = (np.array(x, np.uint64) for x in zip(*family(n, prime), strict=True))
    p, most = np.uint64(prime), (2**64 - prime) // prime

    def run(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)[:, None]
        if x.size and x.max() > most:  # a * x would overflow
            h = a * (x >> np.uint64(16))
            h -= h // p * p
            h = h * np.uint64(65536) + a * (x & np.uint64(65535))
        else:
            h = x * a
        h += b
        h -= h // p * p  # faster than %
        return h

    return run


def small(item: Column) -> Column:
    """Any item as a number that universal() takes: whole numbers in range stay, all else is hashed to 31 bits."""
    return F.pmod(F.xxhash64(item), F.lit(LARGEST))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint32(r) | x >> np.uint32(32 - r)


def murmur3_seeds(m: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(items, seeds): MurmurHash3 x86 32 bit, unsigned, of items of equal length, the rows of m, a matrix of bytes."""
    n = m.shape[1]
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    h = np.repeat(seeds.astype(np.uint32)[None], len(m), axis=0)
    for k in np.ascontiguousarray(m[:, : n // 4 * 4]).view("<u4").T.astype(np.uint32):
        h ^= (_rotl(k * c1, 15) * c2)[:, None]
        h = _rotl(h, 13)
        h *= np.uint32(5)
        h += np.uint32(0xE6546B64)
    if n % 4:
        k = np.zeros(len(m), np.uint32)
        for j in range(n % 4):
            k |= m[:, n // 4 * 4 + j].astype(np.uint32) << np.uint32(8 * j)
        h ^= (_rotl(k * c1, 15) * c2)[:, None]
    h ^= np.uint32(n & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def by_length(items: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of bytes) of the items of each length, places ascending."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        by.setdefault(len(x), []).append(i)
    return [(np.array(at), np.frombuffer(b"".join(items[i] for i in at), np.uint8).reshape(len(at), n)) for n, at in by.items()]


def murmur3(items: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86 32 bit, signed; items of equal length are hashed together."""
    out = np.zeros(len(items), np.int32)
    for at, m in by_length(items):
        out[at] = murmur3_seeds(m, np.array([seed & 0xFFFFFFFF]))[:, 0].view(np.int32)
    return out


def murmur(item: Column, seed: int = 0) -> Column:
    """The absolute value of MurmurHash3 of an item's text; null for null. Arrow batches."""

    @F.arrow_udf("long")
    def run(x: pa.Array) -> pa.Array:
        h = np.abs(murmur3([(v or "").encode() for v in x.to_pylist()], seed).astype(np.int64))
        return pa.array(h, pa.int64(), mask=x.is_null().to_numpy(zero_copy_only=False))

    return run(item.cast("string"))


def murmurs(item: Column, n: int) -> Column:
    """The absolute values of MurmurHash3 of an item's text with seeds 0 to n - 1, as an array; null for null. Arrow batches."""

    @F.arrow_udf("array<long>")
    def run(x: pa.Array) -> pa.Array:
        items = [(v or "").encode() for v in x.to_pylist()]
        h = np.empty((len(items), n), np.int64)
        for at, m in by_length(items):
            for k in range(0, len(at), 128):  # small enough for the processor's cache
                h[at[k : k + 128]] = murmur3_seeds(m[k : k + 128], np.arange(n)).view(np.int32)
        offsets = pa.array(np.arange(len(items) + 1) * n, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.abs(h).ravel()), mask=x.is_null())

    return run(item.cast("string"))
