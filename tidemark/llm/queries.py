"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, exact_dedup, license_scan, line_dedup, near_dedup, sharding, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes (spark, sf_dir)."""
    return {
        "op1_minhash_near_dedup": near_dedup.query,
        "op2_bpe": bpe.query,
        "op3_sharding": sharding.query,
        "shard_sizes": sharding.sizes_query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_warc": warc.query,
        "op6_toxicity": toxicity.query,
        "op7_license_scan": license_scan.query,
        "op8_decontamination": decontamination.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_line_dedup": line_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query, where SQL can express one on whole tables in reasonable time."""
    return {"op1_minhash_near_dedup": near_dedup.SQL, "op4_exact_dedup": exact_dedup.SQL, "op7_license_scan": license_scan.sql()}
