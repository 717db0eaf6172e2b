"""Schemas of the inputs, and the parameters of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

_F = T.StructField

#: One edit of one page, as batch input has it.
REVISIONS = T.StructType([
    _F("wiki", T.StringType()), _F("page_id", T.LongType()), _F("page_title", T.StringType()), _F("page_namespace", T.IntegerType()),
    _F("revision_id", T.LongType()), _F("parent_id", T.LongType()), _F("timestamp", T.TimestampType()), _F("contributor_id", T.LongType()),
    _F("contributor_name", T.StringType()), _F("is_anonymous", T.BooleanType()), _F("comment", T.StringType()), _F("text_bytes", T.LongType()),
])

#: One event of the live feed.
EVENTS = T.StructType([
    _F("wiki", T.StringType()), _F("title", T.StringType()), _F("user", T.StringType()), _F("bot", T.BooleanType()), _F("timestamp", T.LongType()), _F("namespace", T.IntegerType()),
    _F("length", T.StructType([_F("old", T.IntegerType()), _F("new", T.IntegerType())])), _F("comment", T.StringType()), _F("type", T.StringType()),
])


@dataclass(frozen=True)
class Settings:
    """What an analysis can be told; every operator takes these as arguments too."""

    wikis: tuple[str, ...] = ("enwiki", "dewiki", "frwiki", "eswiki", "jawiki")
    window: str = "1 hour"
    watermark: str = "2 hours"
    top_k: int = 20
    bloom_bits: int = 1_000_000
    bloom_hashes: int = 7
    fm_hashes: int = 64
    minhash_hashes: int = 128
    bands: tuple[tuple[int, int], ...] = ((16, 8), (32, 4), (64, 2), (128, 1))
    threshold: float = 0.05
    k_values: tuple[int, ...] = (2, 5, 10)
    min_year: int = 2010

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a parsed configuration; keys that aren't known raise ValueError."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in values.items()})
