"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, no punctuation, no copyright lines, one spelling of words that
have several. The digest of the entire text, and of each of its entire lines, is hash-joined to the digests of known
licences and licence notices, which went through the same form. Everything runs in the JVM.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh
from .license_texts import DIGESTS, NOTICES, TEXTS

#: Licences up to which their table is broadcast (100 bytes each), so that only what a document holds is shuffled.
BROADCAST = 100_000

#: Words of the same meaning, each with the one it is written as. Compounds become two words, as hyphens go.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analyse": "analyze", "artefact": "artifact", "artefacts": "artifacts", "authorisation": "authorization",
    "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourable": "favorable", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelled": "labeled", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "modelled": "modeled", "noncommercial": "non commercial", "noncommercially": "non commercially", "noninfringement": "non infringement", "nonexclusive": "non exclusive", "offence": "offense", "organisation": "organization", "organisations": "organizations", "percent": "per cent",
    "practise": "practice", "programme": "program", "recognised": "recognized", "sublicense": "sub license", "sublicence": "sub license", "sublicensed": "sub licensed", "sublicensing": "sub licensing", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(portions )?(copyright[ \t]*(\(c\)|©|:|[0-9]|<|\[|\{|by )|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"

#: What follows "copyright" where a licence's own sentence goes on at a line's beginning, rather than a name.
_OWN = "and|or|in|of|on|to|is|are|as|at|for|from|with|that|which|under|within|act|claims?|disclaimers?|holders?|information|infringements?|interests?|laws?|licen[cs](?:e|es|ed|ing)|management|notices?|owners?|ownership|permissions?|protections?|rights?|statements?|status|terms?|treaty|treaties"
#: Lines of a name without a sign, too. The SQL has _COPYRIGHT alone: DuckDB's expressions can't look ahead.
_NAMED = rf"(^|\n)[^a-z0-9\n]*(portions )?copyright[ \t]+(?!(?:{_OWN})(?![\p{{L}}\p{{N}}]))\p{{L}}[^\n]*"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical(text: Column, spellings: dict[str, str] | None = None) -> Column:
    """The canonical form of a text, line by line: words with one blank on each side, lines with a newline between them. Null gives
    null."""
    x = F.regexp_replace(F.lower(F.replace(text, F.lit("\r"), F.lit("\n"))), f"{_COPYRIGHT}|{_NAMED}", "\n")
    x = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", "  "), r"\n", "  \n  "), F.lit("  "))
    for a, b in (SPELLINGS if spellings is None else spellings).items():
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(x, " +", " ")


def _digest(x: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(x, r"\s+", " ")), 256)


def known(spark: SparkSession) -> DataFrame:
    """(license, digest) of the licences and notices that come with this module."""
    texts = spark.createDataFrame(TEXTS + NOTICES, "license string, text string").select("license", _digest(canonical(F.col("text"))).alias("digest"))
    return texts.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string")) if DIGESTS else texts


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, notices) for every row of docs: the licence that the entire text is, and the licences whose
    texts or notices are entire lines of it, sorted, comma between them; null where there is none.

    licenses: (license, digest), digests as known() makes them; of several licences for a digest the first in order counts. A null or empty text has
    neither. Repeated rows and null ids are kept; an empty table gives an empty one. A copyright line ends at the line's end: a licence on the same line
    isn't recognised. Other columns don't matter, whatever their names."""
    licenses = (known(docs.sparkSession) if licenses is None else licenses).groupBy(F.col("digest").alias("_d")).agg(F.min("license").alias("_l"))
    x = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), canonical(F.col(f"`{text_col}`")).alias("_c"))
    lines = F.array_distinct(F.filter(F.transform(F.split("_c", "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    digests = F.array_append(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda s: F.struct(F.lit(False).alias("whole"), F.sha2(s, 256).alias("_d"))), F.struct(F.lit(True).alias("whole"), _digest(F.col("_c")).alias("_d")))
    each = x.select("_row", "_id", F.explode(digests).alias("_e")).select("_row", "_id", "_e.whole", "_e._d")
    hit = each.join(F.broadcast(licenses) if licenses.limit(BROADCAST + 1).count() <= BROADCAST else licenses, "_d", "left")
    out = hit.groupBy("_row", "_id").agg(F.min(F.when(F.col("whole"), F.col("_l"))).alias("license"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("_l")))).alias("_n"))
    notices = F.when(F.size("_n") > 0, F.array_join("_n", ","))
    return out.select(F.col("_id").alias(fresh(["license", "notices"], id_col)), "license", notices.alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents for the licences that come with this module."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(x: str) -> str:
    x = f"regexp_replace(lower(replace({x}, chr(13), chr(10))), {_quoted(_COPYRIGHT)}, chr(10), 'g')"
    x = f"'  ' || regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g'), '\\n', '  ' || chr(10) || '  ', 'g') || '  '"
    for a, b in SPELLINGS.items():
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


@cache
def sql() -> str:
    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEXTS + NOTICES)
    given = "".join(f" UNION ALL SELECT {_quoted(a)}, {_quoted(b)}" for a, b in DIGESTS)
    digest = lambda c: f"sha256(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"""
WITH kt AS (SELECT license, {_sql_canonical("text")} AS c FROM (VALUES {values}) v(license, text)),
k AS (SELECT digest, min(license) AS license FROM (SELECT license, {digest("c")} AS digest FROM kt{given}) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS c FROM documents),
w AS (SELECT r, doc_id, k.license FROM d LEFT JOIN k ON k.digest = {digest("d.c")}),
l AS (SELECT DISTINCT r, trim(unnest(string_split(c, chr(10)))) AS line FROM d),
n AS (SELECT r, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM l JOIN k ON k.digest = sha256(line) WHERE line <> '' GROUP BY r)
SELECT w.doc_id, w.license, n.notices FROM w LEFT JOIN n USING (r)
"""
