"""The registered queries: every operator on whole tables, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import activity_bucket, window_label
from ..functions.hashing import PRIME, family, murmur
from ..operators import activity as A
from ..operators import privacy as P
from ..operators import sets as S
from ..operators import similarity as M
from ..operators import sketches as K
from ..sources import events as E
from ..sources.shared import shared_path
from ..streaming import windows as T

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
YEAR = 1996
CONFIGS = M.CONFIGS
SIZES = (10_000, 100_000, 500_000, 1_000_000, 5_000_000)
THRESHOLD = 0.6


def _add(sql: str | None = None):
    def put(f):
        name = f.__name__
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return _table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _text(window: str = "window"):
    return F.date_format(F.col(window)["start"], "yyyy-MM-dd HH:mm:ss").alias("window_start")


# --- activity ---------------------------------------------------------------------------------------------------

_STATS = "SELECT event_type, count(*) AS actions, count(DISTINCT user_id) AS actors, round(sum(CASE WHEN value > 0 THEN value END), 2) AS volume, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type"


@_add(_STATS)
def activity_stats(spark, d):
    x = A.activity_stats(_table(spark, d, "events"), "event_type", "user_id", "value")
    return x.withColumn("volume", F.round("volume", 2)).withColumn("mean_value", F.round("mean_value", 4))


@_add()
def activity_stats_hll(spark, d):
    return A.activity_stats(_table(spark, d, "events"), "event_type", "user_id", "value", approximate=True)


@_add("SELECT count(*) AS rows FROM lineitem")
def row_count(spark, d):
    return _table(spark, d, "lineitem").agg(F.count("*").alias("rows"))


@_add("""SELECT l_returnflag, l_partkey, actions, actors, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY actions DESC, l_partkey) AS rank FROM
(SELECT l_returnflag, l_partkey, count(*) AS actions, count(DISTINCT l_suppkey) AS actors FROM lineitem GROUP BY ALL)) WHERE rank <= 20""")
def top_items(spark, d):
    return A.top_items(_table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_suppkey")


_YEARLY = f"SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS actions FROM orders WHERE o_orderdate >= '{YEAR}-01-01' GROUP BY ALL"


@_add(_YEARLY)
def yearly(spark, d):
    return A.yearly(_table(spark, d, "orders"), "o_orderpriority", "o_orderdate", YEAR)


_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@_add(f"SELECT year, {', '.join(f"CAST(coalesce(sum(CASE WHEN o_orderpriority = '{k}' THEN actions END), 0) AS BIGINT) AS {v}" for k, v in _PRIORITIES.items())} FROM ({_YEARLY}) GROUP BY year")
def yearly_pivot(spark, d):
    return A.yearly_pivot(_table(spark, d, "orders"), "o_orderpriority", "o_orderdate", list(_PRIORITIES), YEAR).withColumnsRenamed(_PRIORITIES)


@_add("SELECT o_orderpriority, count(*) AS actors, round(avg(n), 6) AS actions_per_actor FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def productivity(spark, d):
    return _rounded(A.productivity(_table(spark, d, "orders"), "o_orderpriority", "o_custkey"))


@_add("SELECT o_orderpriority, actions, count(*) AS actors FROM (SELECT o_orderpriority, o_custkey, count(*) AS actions FROM orders GROUP BY ALL) GROUP BY ALL")
def frequency_histogram(spark, d):
    return A.frequency_histogram(_table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@_add("""SELECT bin, round(lo + bin * (hi - lo) / 50, 4) AS low, round(lo + (bin + 1) * (hi - lo) / 50, 4) AS high, count(*) AS n FROM
(SELECT lo, hi, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) GROUP BY bin, lo, hi""")
def equal_width_histogram(spark, d):
    return _rounded(A.equal_width_histogram(_table(spark, d, "orders"), "o_totalprice"), 4)


@_add("""SELECT o_orderpriority, o_custkey, actions, round(row_number() OVER w * 100.0 / count(*) OVER p, 6) AS actors_pct, round(CAST(sum(actions) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0 / sum(actions) OVER p, 6) AS actions_pct
FROM (SELECT o_orderpriority, o_custkey, count(*) AS actions FROM orders GROUP BY ALL) WINDOW p AS (PARTITION BY o_orderpriority), w AS (PARTITION BY o_orderpriority ORDER BY actions DESC, o_custkey)""".replace("OVER w *", "OVER (PARTITION BY o_orderpriority ORDER BY actions DESC, o_custkey) *").replace("OVER (w ROWS", "OVER (PARTITION BY o_orderpriority ORDER BY actions DESC, o_custkey ROWS").replace(", w AS (PARTITION BY o_orderpriority ORDER BY actions DESC, o_custkey)", ""))
def lorenz_curve(spark, d):
    return A.lorenz(_table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@_add("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_new FROM events")
def first_seen(spark, d):
    return A.first_seen(_table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "is_new")


@_add()
def distinct_errors(spark, d):
    return A.distinct_errors(_table(spark, d, "lineitem"), "l_returnflag", "l_suppkey", "l_partkey")


@_add("SELECT l_returnflag, l_suppkey, exact FROM (SELECT l_returnflag, l_suppkey, count(DISTINCT l_partkey) AS exact FROM lineitem GROUP BY ALL) WHERE exact >= 50 ORDER BY exact DESC, l_returnflag, l_suppkey LIMIT 100")
def top_distinct(spark, d):
    """The exact side of distinct_errors."""
    return distinct_errors(spark, d).select("l_returnflag", "l_suppkey", "exact")


@_add()
def storage_ratio(spark, d):
    return A.storage_ratio(spark, f"{d}/lineitem.parquet", f"{d}/orders.parquet")


@_add("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_linestatus")
def linear_fit(spark, d):
    x = A.linear_fit(_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"])
    return x.withColumn("slope", F.round("slope", 4)).withColumn("intercept", F.round("intercept", 2))


@_add("SELECT c_custkey, CASE WHEN n = 1 THEN '1_single' WHEN n <= 5 THEN '2_low' WHEN n <= 20 THEN '3_medium' WHEN n <= 100 THEN '4_high' ELSE '5_power' END AS bucket FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def activity_buckets(spark, d):
    n = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    x = _table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", activity_bucket(F.coalesce("n", F.lit(0))).alias("bucket"))


# --- windows ----------------------------------------------------------------------------------------------------

_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"


@_add(f"SELECT {_HOUR} AS window_start, event_type, count(*) AS actions, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS bot_actions FROM events GROUP BY ALL")
def hourly_stats(spark, d):
    x = _table(spark, d, "events").withColumn("bot", F.col("value") > 50)
    return T.windowed_stats(x, "ts", "event_type", "user_id", "bot").select(_text(), "event_type", "actions", "bot_actions")


@_add(f"SELECT {_HOUR} AS window_start, event_type, count(DISTINCT user_id) AS actors FROM events GROUP BY ALL")
def hourly_exact_distinct(spark, d):
    x = T.with_watermark(_table(spark, d, "events"), "ts")
    return x.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count_distinct("user_id").alias("actors")).select(_text(), "event_type", "actors")


_ITEM = "json_extract_string(props, '$.k')"
_COUNTS = f"SELECT {_HOUR} AS window_start, event_type, {_ITEM} AS item, count(*) AS actions FROM events GROUP BY ALL"


@_add(_COUNTS)
def hourly_item_counts(spark, d):
    return T.windowed_counts(_events(spark, d), "ts", "event_type", "item").select(_text(), "event_type", "item", "actions")


@_add(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, event_type ORDER BY actions DESC, item) AS INTEGER) AS rank FROM ({_COUNTS.replace('hour', 'day')}) WHERE item IS NOT NULL) WHERE rank <= 20")
def trending(spark, d):
    return T.top_k(T.windowed_counts(_events(spark, d), "ts", "event_type", "item", "1 day"), "event_type", "item").select(_text(), "event_type", "item", "actions", "rank")


@_add(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, event_type ORDER BY actions DESC, item) AS INTEGER) AS rank FROM ({_COUNTS.replace('hour', 'day')}) WHERE item IS NOT NULL) WHERE event_type = 'click' AND window_start = '2024-01-05 00:00:00' AND rank <= 10")
def nearest_ranks(spark, d):
    """The top of one window and key, as a report shows it."""
    return A.nearest_ranks(trending(spark, d), {"event_type": "click", "window_start": "2024-01-05 00:00:00"}, 10)


@_add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') || ' → ' || strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%H:%M') AS label, count(*) AS actions FROM events GROUP BY 1")
def window_labels(spark, d):
    x = T.with_watermark(_table(spark, d, "events"), "ts").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("actions"))
    return x.select(window_label(F.col("window")).alias("label"), "actions")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).getFileStatus(p).isDirectory()
    s = spark.readStream.schema(_table(spark, d, "events").schema)
    return s.option("recursiveFileLookup", "true").parquet(path) if folder else s.option("pathGlobFilter", "events.parquet").parquet(d)


_DONE = "date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)"


@_add(f"SELECT {_HOUR} AS window_start, event_type, count(*) AS actions FROM events WHERE {_DONE} GROUP BY ALL")
def stream_hourly_stats(spark, d):
    """A stream run over all events; the windows that the watermark has passed."""
    out, at = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    T.to_parquet(T.windowed_stats(_stream(spark, d), "ts", "event_type", "user_id"), out, at, once=True).awaitTermination()
    return spark.read.parquet(out).select(_text(), "event_type", "actions")


@_add(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, event_type ORDER BY actions DESC, item) AS INTEGER) AS rank FROM (SELECT {_HOUR} AS window_start, event_type, {_ITEM} AS item, count(*) AS actions FROM events WHERE {_DONE} GROUP BY ALL) WHERE item IS NOT NULL) WHERE rank <= 20")
def stream_trending(spark, d):
    """Finished windows are ranked as the stream emits them."""
    out, at = shared_path(spark, "trending"), shared_path(spark, "trending-state")
    x = _stream(spark, d).withColumn("item", F.get_json_object("props", "$.k"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    T.trending(T.windowed_counts(x, "ts", "event_type", "item"), "event_type", "item", sink, at, once=True).awaitTermination()
    return spark.read.parquet(out).select(_text(), "event_type", "item", "actions", "rank")


@_add("SELECT event_type AS wiki, user_id AS namespace, CAST(epoch(ts) AS BIGINT) // 1 AS timestamp FROM events WHERE event_type IN ('click', 'view')".replace("CAST(epoch(ts) AS BIGINT) // 1", "CAST(floor(epoch(ts)) AS BIGINT)").replace("user_id AS namespace", "CAST(0 AS INTEGER) AS namespace"))
def event_wanted(spark, d):
    """All events as JSON messages, decoded and filtered."""
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = _table(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("wiki"), ts.alias("timestamp"), F.lit(0).alias("namespace"), F.lit("edit").alias("type"))).alias("value"))
    return E.wanted(E.decode(raw), ["click", "view"]).select("wiki", "namespace", "timestamp")


# --- privacy ----------------------------------------------------------------------------------------------------

_BUCKET = "CASE WHEN n = 1 THEN '1_single' WHEN n <= 5 THEN '2_low' WHEN n <= 20 THEN '3_medium' WHEN n <= 100 THEN '4_high' ELSE '5_power' END"
_GROUPS = f"SELECT o_orderpriority, year, {_BUCKET} AS bucket, count(DISTINCT o_custkey) AS actors, count(*) AS records FROM (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= '{YEAR}-01-01' GROUP BY ALL) GROUP BY ALL"


def _groups(spark, d):
    return P.groups(_table(spark, d, "orders"), "o_orderpriority", "o_custkey", "o_orderdate", YEAR)


@_add(_GROUPS)
def kanon_groups(spark, d):
    return _groups(spark, d)


@_add(f"SELECT * FROM ({_GROUPS}) WHERE actors >= 10")
def kanon_kept(spark, d):
    return P.kept(_groups(spark, d), 10)


@_add(f"SELECT * FROM ({_GROUPS}) WHERE actors < 10")
def kanon_suppressed(spark, d):
    return P.suppressed(_groups(spark, d), 10)


@_add(f"""SELECT CAST(k AS INTEGER) AS k, count(*) AS groups, count(*) FILTER (actors >= k) AS groups_kept, count(*) FILTER (actors < k) AS groups_suppressed, round(count(*) FILTER (actors < k) * 100.0::DOUBLE / count(*), 2) AS groups_suppressed_pct,
CAST(sum(actors) AS BIGINT) AS actors, CAST(coalesce(sum(actors) FILTER (actors >= k), 0) AS BIGINT) AS actors_kept, CAST(coalesce(sum(actors) FILTER (actors < k), 0) AS BIGINT) AS actors_suppressed, round(coalesce(sum(actors) FILTER (actors < k), 0) * 100.0::DOUBLE / sum(actors), 2) AS actors_suppressed_pct
FROM ({_GROUPS}), (VALUES (2), (5), (10)) v(k) GROUP BY k""")
def kanon_statistics(spark, d):
    return P.statistics(_groups(spark, d))


# --- sets and similarity ----------------------------------------------------------------------------------------

_LONG = "SELECT DISTINCT o_orderpriority AS s, o_custkey AS item FROM orders"
_FAMILY = lambda n: "(VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, a, b in family(n)) + ") f(i, a, b)"
_SIGNED = f"SELECT s, CAST(i AS INTEGER) AS i, min((a * item + b) % {PRIME}) AS h FROM ({_LONG}), {_FAMILY(128)} GROUP BY s, i"
_EXACT = f"""SELECT a, b, common, total, round(CASE WHEN total = 0 THEN 0 ELSE common / total::DOUBLE END, 6) AS jaccard FROM (SELECT p.a, p.b, coalesce(c.common, 0) AS common, na.n + nb.n - coalesce(c.common, 0) AS total FROM
(SELECT x.s AS a, y.s AS b FROM (SELECT DISTINCT s FROM ({_LONG})) x, (SELECT DISTINCT s FROM ({_LONG})) y WHERE x.s < y.s) p
LEFT JOIN (SELECT x.s AS a, y.s AS b, count(*) AS common FROM ({_LONG}) x JOIN ({_LONG}) y USING (item) WHERE x.s < y.s GROUP BY ALL) c USING (a, b)
JOIN (SELECT s, count(*) AS n FROM ({_LONG}) GROUP BY s) na ON na.s = p.a JOIN (SELECT s, count(*) AS n FROM ({_LONG}) GROUP BY s) nb ON nb.s = p.b)"""
_ESTIMATED = f"WITH g AS ({_SIGNED}) SELECT x.s AS a, y.s AS b, round(count(*) FILTER (x.h = y.h) / 128.0::DOUBLE, 6) AS estimate FROM g x JOIN g y USING (i) WHERE x.s < y.s GROUP BY ALL"
_CONF = "(VALUES " + ", ".join(f"({b}, {r})" for b, r in CONFIGS) + ") c(bands, nrows)"
_CANDIDATES = f"WITH g AS ({_SIGNED}), v AS (SELECT bands, nrows, i // nrows AS band, s, string_agg(h::VARCHAR, ',' ORDER BY i) AS value FROM g, {_CONF} WHERE i < bands * nrows GROUP BY ALL) SELECT DISTINCT CAST(x.bands AS INTEGER) AS bands, CAST(x.nrows AS INTEGER) AS rows, x.s AS a, y.s AS b FROM v x JOIN v y USING (bands, nrows, band, value) WHERE x.s < y.s"


def _long(spark, d) -> DataFrame:
    return S.members(_table(spark, d, "orders").withColumnRenamed("o_orderpriority", "s"), "s", "o_custkey")


@_add(f"SELECT s, array_to_string(list_sort(list(item)), ',') AS items, count(*) AS n FROM ({_LONG}) GROUP BY s HAVING count(*) >= 10")
def gathered_sets(spark, d):
    return S.gathered(_long(spark, d), "s", 10).select("s", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n")


@_add("SELECT l_partkey, item FROM (SELECT DISTINCT l_partkey, l_suppkey AS item FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_partkey) >= 10")
def item_sets(spark, d):
    return S.at_least(S.members(_table(spark, d, "lineitem"), "l_partkey", "l_suppkey"), "l_partkey", 10)


@_add(f"SELECT DISTINCT item FROM ({_LONG})")
def united_sets(spark, d):
    return S.united(_long(spark, d))


@_add("SELECT o_orderkey AS item FROM orders UNION SELECT c_custkey FROM customer")
def united_tables(spark, d):
    a, b = _table(spark, d, "orders").select(F.col("o_orderkey").alias("item")), _table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    return S.united(a.unionByName(b))


@_add("SELECT unnest(range((SELECT max(o_custkey) FROM orders) + 1, (SELECT max(o_custkey) FROM orders) + 5001)) AS item")
def absent_items(spark, d):
    return S.absent(_long(spark, d), 5000)


@_add(_EXACT)
def jaccard_exact(spark, d):
    return _rounded(M.exact(_long(spark, d), "s"))


@_add(_SIGNED)
def minhash_signatures(spark, d):
    return M.signatures(_long(spark, d), "s")


@_add(_ESTIMATED)
def minhash_jaccard(spark, d):
    g = M.signatures(_long(spark, d), "s")
    return _rounded(M.estimated(g, g, "s", "s"))


@_add(f"SELECT a, b, e.jaccard, m.estimate FROM ({_EXACT}) e JOIN ({_ESTIMATED}) m USING (a, b)")
def jaccard_comparison(spark, d):
    long = _long(spark, d)
    g = M.signatures(long, "s")
    return _rounded(M.exact(long, "s").join(M.estimated(g, g, "s", "s"), ["a", "b"]).select("a", "b", "jaccard", "estimate"))


@_add(f"SELECT round(avg(abs(estimate - jaccard) / jaccard * 100), 4) AS mape, round(median(abs(estimate - jaccard) / jaccard * 100), 4) AS median_error, round(max(abs(estimate - jaccard) / jaccard * 100), 4) AS max_error, round(avg(abs(estimate - jaccard)), 4) AS mae FROM ({_EXACT}) e JOIN ({_ESTIMATED}) m USING (a, b)")
def error_summary(spark, d):
    return _rounded(A.error_summary(jaccard_comparison(spark, d), "estimate", "jaccard"), 4)


@_add(f"SELECT a, b, jaccard FROM ({_EXACT}) UNION ALL SELECT b, a, jaccard FROM ({_EXACT}) UNION ALL SELECT DISTINCT s, s, 1.0::DOUBLE FROM ({_LONG})")
def similarity_matrix(spark, d):
    return _rounded(M.matrix(M.exact(_long(spark, d), "s"), "jaccard"))


@_add(_CANDIDATES)
def lsh_candidates(spark, d):
    return M.candidates(M.signatures(_long(spark, d), "s"), "s")


_SWEEP = f"""SELECT CAST(bands AS INTEGER) AS bands, CAST(nrows AS INTEGER) AS rows, 'b=' || bands || ',r=' || nrows AS label, count(f.a) AS candidates, round(CASE WHEN count(f.a) = 0 THEN 0 ELSE count(t.a) / count(f.a)::DOUBLE END, 6) AS precision,
round(CASE WHEN max(n) = 0 THEN 0 ELSE count(t.a) / max(n)::DOUBLE END, 6) AS recall FROM {_CONF} LEFT JOIN ({_CANDIDATES}) f ON f.bands = c.bands AND f.rows = c.nrows LEFT JOIN (SELECT a, b FROM ({_EXACT}) WHERE jaccard >= {THRESHOLD}) t ON t.a = f.a AND t.b = f.b,
(SELECT count(*) AS n FROM ({_EXACT}) WHERE jaccard >= {THRESHOLD}) GROUP BY c.bands, c.nrows""".replace("CAST(bands", "CAST(c.bands").replace("'b=' || bands", "'b=' || c.bands")


@_add(_SWEEP)
def lsh_precision_recall(spark, d):
    return _rounded(M.band_sweep(_long(spark, d), "s", CONFIGS, THRESHOLD))


@_add(f"SELECT label, unnest(['precision', 'recall']) AS metric, unnest([precision, recall]) AS value FROM ({_SWEEP})")
def lsh_melted(spark, d):
    return lsh_precision_recall(spark, d).unpivot(["label"], ["precision", "recall"], "metric", "value")


_PERTURBED = f"""SELECT origin, level, item FROM (SELECT s AS origin, item, row_number() OVER (PARTITION BY s ORDER BY (item * 2654435761) % 4294967296, item) AS r, count(*) OVER (PARTITION BY s) AS n FROM ({_LONG})), (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.5)) v(level) WHERE r > floor(n * level)
UNION ALL SELECT origin, level, unnest(range(top + 1, top + 1 + CAST(floor(n * level) AS BIGINT))) FROM (SELECT s AS origin, count(*) AS n FROM ({_LONG}) GROUP BY s), (SELECT max(item) AS top FROM ({_LONG})), (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.5)) v(level)"""


@_add(_PERTURBED)
def perturbed_sets(spark, d):
    return S.perturbed(_long(spark, d), "s")


@_add(f"""WITH p AS ({_PERTURBED}), l AS ({_LONG}), g AS ({_SIGNED}), q AS (SELECT origin, level, CAST(i AS INTEGER) AS i, min((a * item + b) % {PRIME}) AS h FROM p, {_FAMILY(128)} GROUP BY ALL),
x AS (SELECT p.origin, p.level, count(l.item) AS common, count(*) AS n FROM p LEFT JOIN l ON l.s = p.origin AND l.item = p.item GROUP BY ALL), z AS (SELECT s, count(*) AS n FROM l GROUP BY s),
e AS (SELECT q.origin, q.level, count(*) FILTER (q.h = g.h) / 128.0::DOUBLE AS estimate FROM q JOIN g ON g.s = q.origin AND g.i = q.i GROUP BY ALL)
SELECT origin, level, round(common / (x.n + z.n - common)::DOUBLE, 6) AS expected, round(estimate, 6) AS estimate, round(abs(estimate - common / (x.n + z.n - common)::DOUBLE), 6) AS error FROM x JOIN z ON z.s = x.origin JOIN e USING (origin, level)""")
def synthetic_evaluation(spark, d):
    long = _long(spark, d)
    p = S.perturbed(long, "s")
    n = long.groupBy(F.col("s").alias("origin")).agg(F.count("*").alias("n"))
    x = p.join(long.select(F.col("s").alias("origin"), "item", F.lit(1).alias("there")), ["origin", "item"], "left").groupBy("origin", "level").agg(F.count("there").alias("common"), F.count("*").alias("m"))
    expected = x.join(n, "origin").select("origin", "level", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("expected"))
    g, q = M.signatures(long, "s"), M.signatures(p, ["origin", "level"])
    e = q.join(g.select(F.col("s").alias("origin"), "i", F.col("h").alias("o")), ["origin", "i"]).groupBy("origin", "level").agg((F.count_if(F.col("h") == F.col("o")) / F.lit(128.0)).alias("estimate"))
    return _rounded(expected.join(e, ["origin", "level"]).withColumn("error", F.abs(F.col("estimate") - F.col("expected"))))


@_add(f"SELECT round(i / 199.0::DOUBLE, 6) AS similarity, CAST(bands AS INTEGER) AS bands, CAST(nrows AS INTEGER) AS rows, round(1 - pow(1 - pow(i / 199.0::DOUBLE, nrows), bands), 6) AS detected FROM range(200) r(i), {_CONF}")
def detection_curve(spark, d):
    return _rounded(M.detection_curve(spark))


@_add()
def mllib_similarity_join(spark, d):
    return M.mllib_pairs(_long(spark, d), "s")


# --- sketches ---------------------------------------------------------------------------------------------------

_BITS = lambda m, k, items: f"SELECT DISTINCT ((a * item + b) % {PRIME}) % {m} AS place FROM ({items}), {_FAMILY(k)}"
_KNOWN = "SELECT DISTINCT o_custkey AS item FROM orders"


@_add(_BITS(1_000_000, 7, _KNOWN))
def bloom_bits(spark, d):
    return K.bloom_bits(_table(spark, d, "orders").select(F.col("o_custkey").alias("item")), 1_000_000, 7)


@_add(f"SELECT item, bool_and(s.place IS NOT NULL) AS contained FROM (SELECT DISTINCT item, ((a * item + b) % {PRIME}) % 10000 AS place FROM (SELECT DISTINCT o_orderkey AS item FROM orders), {_FAMILY(3)}) p LEFT JOIN ({_BITS(10_000, 3, _KNOWN)}) s USING (place) GROUP BY item")
def bloom_contains(spark, d):
    o = _table(spark, d, "orders")
    return K.bloom_contains(K.bloom_bits(o.select(F.col("o_custkey").alias("item")), 10_000, 3), o.select(F.col("o_orderkey").alias("item")), 10_000, 3)


_GRID = f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"({m}::BIGINT)" for m in SIZES)}) v(m)), k AS (SELECT * FROM (VALUES {", ".join(f"({k})" for k in K.HASHES)}) v(k)), known AS ({_KNOWN}),
probes AS (SELECT unnest(range(top + 1, top + 5001)) AS item FROM (SELECT max(item) AS top FROM known)),
bits AS (SELECT m, ((a * item + b) % {PRIME}) % m AS place, min(i) AS first FROM known, m, {_FAMILY(10)} GROUP BY ALL),
hit AS (SELECT p.m, k, item, max(coalesce(first, 10)) < k AS found FROM (SELECT m, item, i, ((a * item + b) % {PRIME}) % m AS place FROM probes, m, {_FAMILY(10)}) p LEFT JOIN bits USING (m, place) JOIN k ON i < k GROUP BY p.m, k, item)
SELECT m, CAST(k AS INTEGER) AS k, (SELECT count(*) FROM known) AS adds, round(pow(1 - exp(-k * (SELECT count(*) FROM known) / m::DOUBLE), k), 8) AS expected, round(count(*) FILTER (found) / count(*)::DOUBLE, 8) AS measured, CAST(ceil(m / 8.0) AS BIGINT) AS memory_bytes FROM hit GROUP BY m, k"""


@_add(_GRID)
def bloom_grid(spark, d):
    long = _long(spark, d)
    return _rounded(K.bloom_grid(S.united(long), S.absent(long, 5000), SIZES), 8)


@_add(f"SELECT m, memory_bytes FROM (SELECT DISTINCT m, memory_bytes FROM ({_GRID}))")
def bloom_memory(spark, d):
    return bloom_grid(spark, d).dropDuplicates(["m"]).select("m", "memory_bytes")


@_add(f"""WITH f AS (SELECT o_custkey AS item, min(o_orderkey) AS first_at FROM orders GROUP BY 1), p AS (SELECT DISTINCT item, first_at, ((a * item + b) % {PRIME}) % 5000 AS place FROM f, {_FAMILY(5)}), s AS (SELECT place, min(first_at) AS set_at FROM p GROUP BY place),
u AS (SELECT item, max(set_at) AS all_set_at FROM p JOIN s USING (place) GROUP BY item), x AS (SELECT first_at < o_orderkey AS truth, all_set_at < o_orderkey AS says FROM orders JOIN f ON f.item = o_custkey JOIN u ON u.item = o_custkey)
SELECT count(*) AS rows, count(*) FILTER (NOT truth) AS new, count(*) FILTER (NOT truth AND says) AS false_positives, count(*) FILTER (truth AND NOT says) AS false_negatives, round(count(*) FILTER (NOT truth AND says) / count(*) FILTER (NOT truth)::DOUBLE, 6) AS false_positive_rate FROM x""")
def bloom_stream(spark, d):
    return _rounded(K.bloom_stream(_table(spark, d, "orders"), "o_custkey", "o_orderkey", 5000, 5))


_PAGES = "SELECT l_partkey, item FROM (SELECT DISTINCT l_partkey, l_suppkey AS item FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_partkey) >= 10"
_TZ = f"CASE WHEN (a * item + b) % {PRIME} = 0 THEN 32 ELSE bit_count((((a * item + b) % {PRIME}) & -((a * item + b) % {PRIME})) - 1) END"
_REGISTERS = f"SELECT l_partkey, i, max({_TZ}) AS r FROM ({_PAGES}), {_FAMILY(256)} GROUP BY ALL"


def _fm(registers: str, key: str) -> str:
    return f"SELECT {key}hashes, CAST(floor(pow(2.0, avg(md)) / 0.77351) AS BIGINT) AS estimate FROM (SELECT {key}hashes, i // 8 AS g, median(r) AS md FROM ({registers}), (VALUES (16), (32), (64), (128), (256)) v(hashes) WHERE i < hashes GROUP BY ALL) GROUP BY ALL"


_FM = f"SELECT l_partkey, CAST(hashes AS INTEGER) AS hashes, estimate, exact, round(abs(estimate - exact) * 100.0::DOUBLE / exact, 4) AS error_pct FROM ({_fm(_REGISTERS, 'l_partkey, ')}) JOIN (SELECT l_partkey, count(*) AS exact FROM ({_PAGES}) GROUP BY ALL) USING (l_partkey)"


def _pages(spark, d) -> DataFrame:
    return S.at_least(S.members(_table(spark, d, "lineitem"), "l_partkey", "l_suppkey"), "l_partkey", 10)


@_add(_FM)
def fm_evaluation(spark, d):
    return _rounded(K.fm_evaluation(_pages(spark, d), ["l_partkey"]), 4)


@_add(f"SELECT hashes, round(avg(error_pct), 2) AS mape, round(max(error_pct), 2) AS max_error, hashes * 4 AS memory_bytes FROM ({_FM}) GROUP BY hashes")
def fm_summary(spark, d):
    return _rounded(K.fm_summary(fm_evaluation(spark, d)), 2)


@_add(f"SELECT CAST(hashes AS INTEGER) AS hashes, estimate FROM ({_fm(f'SELECT i, max(r) AS r FROM ({_REGISTERS}) GROUP BY i', '')})")
def fm_merged(spark, d):
    """The estimate for the union of all sets, from their registers."""
    return K.fm_estimates(K.fm_merged(K.fm_registers(_pages(spark, d), ["l_partkey"]), []), [])


@_add()
def bloom_mmh3(spark, d):
    """bloom_bits with the reference's hashes."""
    return K.bloom_bits(_table(spark, d, "orders").select(F.col("o_custkey").alias("item")), 1_000_000, 7, mmh3=True)


@_add()
def fm_mmh3(spark, d):
    """fm_evaluation with the reference's hashes."""
    return _rounded(K.fm_evaluation(_pages(spark, d), ["l_partkey"], mmh3=True), 4)


@_add()
def murmur_hash(spark, d):
    return _table(spark, d, "customer").select("c_custkey", murmur(F.col("c_custkey")).alias("h"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


