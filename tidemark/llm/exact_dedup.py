"""Exact dedup by skew-safe combining.

Three stages, each of which groups by the whole text, so that equal digests alone never drop a document:
copies in one input partition are combined before anything is shuffled (partial aggregation), the partitions'
winners are combined within salted digest groups, and the salts' winners globally. However often a text occurs, no
task gets more than one copy of it from each input partition divided by the number of salts, and the last one at
most one from each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Over how many salts the winners of a digest are spread.
SALTS = 16

SQL = "SELECT * FROM documents QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang, source, n_chars) = 1"


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, copies: str | None = None) -> DataFrame:
    """One row of each text, with all columns of docs: the one with the smallest id (null ids last), on ties the one whose
    other columns come first in their order. copies: the name of an added column with the number of rows that
    had the text.

    Rows whose text is null aren't compared: all stay, with 1 copy each. Empty texts are equal to each other. An empty
    table gives an empty one. Columns of types without an order (maps, variants) raise ValueError.
    """
    names = docs.columns
    if copies is not None and copies.lower() in {n.lower() for n in names}:
        raise ValueError(f"docs already has a column {copies}")
    digest, salt, row, n = (fresh(names, x) for x in ("_digest", "_salt", "_row", "_copies"))
    ordered = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    if len(ordered) + 2 != len(names):
        raise ValueError("columns of maps or variants can't be compared; drop or convert them first")
    q = lambda c: F.col(f"`{c}`")
    # Spark orders nulls first, in min() too; the first field puts null ids last.
    packed = F.struct(q(id_col).isNull().alias("_0"), q(id_col).alias("_1"), *[q(c).alias(f"_c{i}") for i, c in enumerate(ordered)])
    rows = docs.where(q(text_col).isNotNull()).select(q(text_col).alias(text_col), F.xxhash64(q(text_col)).alias(digest), packed.alias(row))
    rows = rows.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    by_salt = rows.groupBy(digest, salt, text_col).agg(F.min(row).alias(row), F.count("*").alias(n))
    won = by_salt.groupBy(digest, text_col).agg(F.min(row).alias(row), F.sum(n).alias(n))
    back = {text_col: q(text_col), id_col: F.col(f"{row}._1")} | {c: F.col(f"{row}._c{i}") for i, c in enumerate(ordered)}
    out = won.select(*[back[c].alias(c) for c in names], *([F.col(n).alias(copies)] if copies else []))
    rest = docs.where(q(text_col).isNull())
    return out.unionByName(rest.withColumn(copies, F.lit(1).cast("long")) if copies else rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicate() of all documents."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
