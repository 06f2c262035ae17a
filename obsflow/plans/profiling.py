"""Sources, projections, joins, profiles, sorts and set operations on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from obsflow.functions import scalar
from obsflow.operators import anomaly, explain, joins, profile
from obsflow.operators.series import daily_mean, granularity, nearest_join, step_counts
from obsflow.plans.catalog import Tables, query, r6
from obsflow.session import checkpoint_folder
from obsflow.sources import tables as src

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources -------------------------------------------------------------------------------------


@query("csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_roundtrip(t: Tables):
    events = t.events
    path = scratch(t, "csv")
    options = {"header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    events.write.options(**options).csv(path)
    return t.spark.read.schema(events.schema).options(**options).csv(path)


@query(
    "parse_ts",
    """
    WITH texts AS (
      SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE '' END || CAST(ts AS VARCHAR) AS txt FROM events
    )
    SELECT event_id, TRY_CAST(txt AS TIMESTAMP) AS ts FROM texts WHERE TRY_CAST(txt AS TIMESTAMP) IS NOT NULL
    """,
)
def parse_ts(t: Tables):
    bad = F.when(F.col("event_type") == "error", "x").otherwise("")
    texts = t.events.select("event_id", F.concat(bad, F.col("ts").cast("string")).alias("ts"))
    return src.parse_timestamps(texts, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("column_candidates", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def column_candidates(t: Tables):
    orders = t.orders
    found = src.get_column_or_raise(orders, ["price", "o_totalprice", "o_custkey"], "price")
    return orders.select("o_orderkey", F.col(found).alias("value"))


@query("parquet_roundtrip", "SELECT * FROM lineitem")
def parquet_roundtrip(t: Tables):
    return src.read_parquet(t.spark, src.write_parquet(t.lineitem, scratch(t, "parquet")))


# --- projections and filters ---------------------------------------------------------------------


@query(
    "region_fallback",
    """
    SELECT c_custkey, coalesce(nullif(r_name, 'ASIA'),
        split_part(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE r_name || '/' || n_name END, '/', 1),
        'Unknown') AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def region_fallback(t: Tables):
    zone = F.when(F.col("c_mktsegment") != "BUILDING", F.concat_ws("/", "r_name", "n_name"))
    placed = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.nullif("r_name", F.lit("ASIA")).alias("continent"), zone.alias("timezone"))
    )
    return src.add_region_column(placed).select("c_custkey", "region")


@query(
    "dropna_subset",
    "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error' AND value <> 0",
)
def dropna_subset(t: Tables):
    holed = t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.nullif("value", F.lit(0.0)).alias("value"),
    )
    return holed.dropna(subset=["event_type", "value"])


@query(
    "complete_cases",
    """
    SELECT count(*) AS rows, count(*) FILTER (WHERE l_discount <> 0 AND l_tax <> 0) AS kept,
           round(100.0 * count(*) FILTER (WHERE l_discount <> 0 AND l_tax <> 0) / count(*), 6) AS kept_pct
    FROM lineitem
    """,
)
def complete_cases(t: Tables):
    holed = t.lineitem.select(
        "l_quantity", *[F.nullif(c, F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")]
    )
    return profile.kept_share(holed, holed.columns).withColumn("kept_pct", r6("kept_pct"))


@query("select_like", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_like(t: Tables):
    lineitem = t.lineitem
    return lineitem.select(*profile.columns_like(lineitem, "KEY"))


@query(
    "provenance_format",
    """
    SELECT page_id, CASE WHEN length(url) > 0 THEN substr(url, 1, 7) ELSE 'unknown' END AS short_sha,
           url AS short_date FROM pages
    """,
)
def provenance_format(t: Tables):
    return t.pages.select(
        "page_id", scalar.short_sha("url").alias("short_sha"), scalar.short_date("url").alias("short_date")
    )


@query(
    "iso_dates",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS short_date,
           strftime(ts, '%Y-%m') AS year_month FROM events
    """,
)
def iso_dates(t: Tables):
    return t.events.select(
        "event_id",
        scalar.iso_utc("ts").alias("iso"),
        scalar.short_date(F.col("ts").cast("string")).alias("short_date"),
        scalar.year_month("ts").alias("year_month"),
    )


# --- joins ---------------------------------------------------------------------------------------


@query(
    "join_inner",
    """
    SELECT o_orderkey, c_mktsegment, n_name, o_totalprice FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """,
)
def join_inner(t: Tables):
    named = joins.lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], keep_missing=False)
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.join_on_feature(orders, named, on="c_custkey").select("o_orderkey", "c_mktsegment", "n_name", "o_totalprice")


@query(
    "join_left_fill",
    """
    SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(max(o_totalprice), 0.0) AS top_price
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """,
)
def join_left_fill(t: Tables):
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )
    return joins.left_join_fill(t.customer.select("c_custkey"), per_customer, ["c_custkey"], {"n_orders": 0, "top_price": 0.0})


@query(
    "align_guard",
    """
    WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders),
         b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds FROM lineitem)
    SELECT count(a.ds) AS rows_a, count(b.ds) AS rows_b, count(*) FILTER (WHERE b.ds IS NULL) AS only_a,
           count(*) FILTER (WHERE a.ds IS NULL) AS only_b,
           count(*) FILTER (WHERE a.ds IS NULL OR b.ds IS NULL) = 0 AS aligned
    FROM a FULL JOIN b ON a.ds = b.ds
    """,
)
def align_guard(t: Tables):
    from obsflow.operators.evaluate import alignment

    return alignment(
        daily_mean(t.orders, "o_orderdate", "o_totalprice"), daily_mean(t.lineitem, "l_shipdate", "l_extendedprice")
    )


@query(
    "broadcast_stats",
    """
    WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sigma FROM events)
    SELECT event_id, round(value - mu, 6) AS centred, round((value - mu) / sigma, 6) AS z FROM events, s
    """,
)
def broadcast_stats(t: Tables):
    events = t.events
    stats = events.agg(F.struct(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))).scalar()
    centred = F.col("value") - stats["mu"]
    return events.select("event_id", r6(centred, "centred"), r6(centred / stats["sigma"], "z"))


@query(
    "join_lookup",
    """
    SELECT c_custkey, n_name, CASE WHEN n_regionkey <> 2 THEN r_name END AS r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def join_lookup(t: Tables):
    customer = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    placed = joins.lookup(customer, t.nation, ["n_nationkey"], keep_missing=False)
    some = t.region.where("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.lookup(placed, some, ["n_regionkey"]).select("c_custkey", "n_name", "r_name")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "pivot_series",
    "SELECT CAST(ts AS DATE) AS ds, "
    + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY 1",
)
def pivot_series(t: Tables):
    daily = daily_mean(t.events, "ts", "value", key="event_type")
    wide = joins.pivot_series(daily, "key", "y", EVENT_TYPES)
    return wide.select("ds", *[r6(e) for e in EVENT_TYPES])


@query(
    "nearest_join",
    """
    WITH grid AS (SELECT DISTINCT date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 12 HOUR AS d FROM orders),
         p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
                      CASE WHEN l_linenumber > 3 THEN l_shipdate + INTERVAL 7 HOUR ELSE l_shipdate END AS moment FROM lineitem),
         prev AS (SELECT p.*, g.d AS before FROM p ASOF LEFT JOIN grid g ON p.moment >= g.d),
         both_ AS (SELECT prev.*, g.d AS after FROM prev ASOF LEFT JOIN grid g ON prev.moment <= g.d)
    SELECT l_orderkey, l_linenumber, l_partkey, moment,
           CASE WHEN after IS NULL OR (before IS NOT NULL AND moment - before <= after - moment) THEN before ELSE after END AS nearest
    FROM both_
    """,
)
def nearest_points(t: Tables):
    grid = t.orders.select((F.date_trunc("day", "o_orderdate") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("d")).distinct()
    later = F.when(F.col("l_linenumber") > 3, F.col("l_shipdate") + F.expr("INTERVAL 7 HOURS")).otherwise(F.col("l_shipdate"))
    probes = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", later.alias("moment"))
    return nearest_join(probes, grid, ts="moment", point_ts="d")


# --- aggregations --------------------------------------------------------------------------------


@query(
    "group_having",
    """
    SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, count(*) AS count
    FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 100
    """,
)
def group_having(t: Tables):
    stats = profile.group_stats(t.lineitem, "l_suppkey", "l_extendedprice", min_count=100)
    return stats.select("l_suppkey", r6("mean", digits=4), r6("std", digits=4), "count").orderBy(F.desc("mean"))


@query(
    "monthly_by_region",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS year_month, r_name, round(avg(o_totalprice), 7) AS y, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    """,
)
def monthly_by_region(t: Tables):
    placed = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "r_name")
    )
    return (
        t.orders.join(placed, "o_custkey")
        .groupBy(scalar.year_month("o_orderdate").alias("year_month"), "r_name")
        .agg(r6(F.avg("o_totalprice"), "y", 7), F.count("*").alias("n"))
    )


@query(
    "seasonality",
    "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1",
)
def seasonality(t: Tables):
    return t.orders.groupBy(F.month("o_orderdate").alias("month")).agg(r6(F.avg("o_totalprice"), "y", 4)).orderBy("month")


@query(
    "null_profile",
    """
    WITH h AS (SELECT event_id, nullif(event_type, 'error') AS event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events),
    c AS (SELECT count(*) AS rows, count(*) - count(event_id) AS a, count(*) - count(event_type) AS b, count(*) - count(value) AS d FROM h)
    SELECT 'event_id' AS feature, rows, a AS nulls, round(100.0 * a / rows, 6) AS null_pct FROM c
    UNION ALL SELECT 'event_type', rows, b, round(100.0 * b / rows, 6) FROM c
    UNION ALL SELECT 'value', rows, d, round(100.0 * d / rows, 6) FROM c
    """,
)
def null_profile(t: Tables):
    holed = t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") <= 100, F.col("value")).alias("value"),
    )
    return profile.null_profile(holed).withColumn("null_pct", r6("null_pct")).orderBy(F.desc("nulls"))


@query(
    "describe_num",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in LINE_FEATURES
    ),
)
def describe_num(t: Tables):
    table = profile.describe_numeric(t.lineitem, LINE_FEATURES)
    return table.select("feature", "count", r6("mean"), r6("std"), "min", r6("q25"), r6("q50"), r6("q75"), "max")


def _describe_cat_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS feature, (SELECT count({c}) FROM {table}) AS count,
        (SELECT count(DISTINCT {c}) FROM {table}) AS unique, {c} AS top, count(*) AS freq
        FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY freq DESC, top LIMIT 1)"""
        for c in cols
    )


@query("describe_cat", _describe_cat_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def describe_cat(t: Tables):
    return profile.describe_categorical(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "nunique",
    """
    SELECT 'c_nationkey' AS feature, count(DISTINCT c_nationkey) AS nunique FROM customer
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT nullif(c_mktsegment, 'BUILDING')) FROM customer
    UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer
    """,
)
def nunique(t: Tables):
    holed = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return profile.nunique(holed, ["c_nationkey", "c_mktsegment", "c_name"])


@query(
    "value_counts",
    """
    SELECT nullif(event_type, 'error') AS value, count(*) AS n FROM events GROUP BY 1
    ORDER BY n DESC, value NULLS LAST LIMIT 10
    """,
)
def value_counts(t: Tables):
    return profile.value_counts(t.events.select(F.nullif("event_type", F.lit("error")).alias("e")), "e", 10)


@query(
    "mode_fill",
    """
    WITH m AS (SELECT p_type FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)
    SELECT p_partkey, coalesce(nullif(part.p_type, 'ECONOMY'), m.p_type) AS p_type FROM part, m
    """,
)
def mode_fill(t: Tables):
    from obsflow.operators.prep import impute_missing_values

    holed = t.part.select("p_partkey", F.nullif("p_type", F.lit("ECONOMY")).alias("p_type"))
    return impute_missing_values(holed, [], ["p_type"])


@query(
    "median_fill",
    """
    WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 7.0) AS l_quantity FROM lineitem),
         m AS (SELECT median(l_quantity) AS med FROM h)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, med) AS l_quantity FROM h, m
    """,
)
def median_fill(t: Tables):
    from obsflow.operators.prep import impute_missing_values

    holed = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"))
    return impute_missing_values(holed, ["l_quantity"], [])


@query(
    "quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.25), 6) AS q1,
        round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.99), 6) AS cap FROM lineitem"""
        for c in LINE_FEATURES
    ),
)
def quantile_table(t: Tables):
    from obsflow.operators.quantiles import quantiles

    table = quantiles(t.lineitem, LINE_FEATURES, {"q1": 0.25, "q2": 0.5, "q3": 0.75, "cap": 0.99})
    return table.select("feature", "n", *[r6(c) for c in ("q1", "q2", "q3", "cap")])


@query(
    "ranges",
    """
    SELECT 'value' AS feature, min(value) AS min, max(value) AS max FROM events
    UNION ALL SELECT 'user_id', CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events
    """,
)
def ranges(t: Tables):
    return profile.ranges(t.events, ["value", "user_id"])


@query("time_range", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM events")
def time_range(t: Tables):
    return t.events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"))


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for a in LINE_FEATURES
        for b in LINE_FEATURES
    ),
)
def corr_matrix(t: Tables):
    return profile.correlation_matrix(t.lineitem, LINE_FEATURES).withColumn("r", r6("r"))


BLOCK = [(a, b) for a in ("l_quantity", "l_discount") for b in ("l_extendedprice", "l_tax", "l_linenumber")]
BLOCK_SQL = (
    "WITH h AS (SELECT l_quantity, nullif(l_discount, 0.0) AS l_discount, l_extendedprice, nullif(l_tax, 0.0) AS l_tax,"
    " l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0), b AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM h" for a, b in BLOCK)
    + ") SELECT * FROM b"
)


def _block(t: Tables):
    holed = t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_linenumber", *[F.nullif(c, F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")]
    )
    block = profile.correlation_block(holed, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax", "l_linenumber"])
    return block.withColumn("r", r6("r"))


@query("corr_block", BLOCK_SQL)
def corr_block(t: Tables):
    return _block(t)


@query("topk_corr", BLOCK_SQL + " ORDER BY abs(r) DESC, x, y LIMIT 4")
def topk_corr(t: Tables):
    return profile.top_correlations(_block(t), 4)


@query(
    "outlier_counts",
    """
    SELECT 'l_quantity' AS feature, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS outliers FROM lineitem
    UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09) FROM lineitem
    """,
)
def outlier_counts(t: Tables):
    return profile.outlier_counts(t.lineitem, {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09)})


@query(
    "box_stats",
    """
    WITH cap AS (SELECT quantile_cont(l_extendedprice, 0.99) AS top FROM lineitem),
    c AS (SELECT l_returnflag, least(l_extendedprice, top) AS v FROM lineitem, cap),
    q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM c GROUP BY 1),
    b AS (SELECT q.*, min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
                 max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
                 count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
          FROM c JOIN q USING (l_returnflag) GROUP BY ALL)
    SELECT l_returnflag, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(whisker_low, 4) AS whisker_low,
           round(whisker_high, 4) AS whisker_high, fliers,
           CAST(row_number() OVER (ORDER BY median DESC, l_returnflag) AS INTEGER) AS place FROM b
    """,
)
def box_stats(t: Tables):
    box = profile.box_stats(t.lineitem, "l_returnflag", "l_extendedprice")
    rounded = [r6(c, digits=4) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
    return box.select("l_returnflag", "n", *rounded, "fliers", "place")


@query(
    "histogram",
    """
    WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS w FROM events)
    SELECT CAST(least(floor((value - lo) / w), 49) AS INTEGER) AS bin,
           round(any_value(lo + least(floor((value - lo) / w), 49) * w), 6) AS lower,
           round(any_value(lo + (least(floor((value - lo) / w), 49) + 1) * w), 6) AS upper, count(*) AS n
    FROM events, s GROUP BY 1
    """,
)
def histogram(t: Tables):
    return profile.histogram(t.events, "value", 50).select("bin", r6("lower"), r6("upper"), "n")


@query(
    "direction_sign",
    """
    SELECT feature, CASE WHEN s > 0 THEN 'up' WHEN s < 0 THEN 'down' END AS direction FROM (
      SELECT l_returnflag AS feature, sum((l_discount - 0.05) * ((l_quantity - 1) / 49 - 0.5)) AS s FROM lineitem GROUP BY 1)
    """,
)
def direction_sign(t: Tables):
    points = t.lineitem.select(
        F.col("l_returnflag").alias("feature"),
        (F.col("l_discount") - 0.05).alias("shap"),
        ((F.col("l_quantity") - 1) / 49).alias("feature_value_norm"),
    )
    return explain.shap_direction(points)


@query(
    "granularity",
    """
    WITH d AS (SELECT date_diff('microsecond', lag(o_orderdate) OVER (ORDER BY o_orderdate), o_orderdate) / 1e6 AS step FROM orders),
    c AS (SELECT step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY step)
    SELECT (SELECT step FROM c ORDER BY n DESC, step LIMIT 1) AS dominant_seconds, max(n) AS dominant_n,
           CAST(coalesce(sum(n) FILTER (WHERE step = 0), 0) AS BIGINT) AS same_ts FROM c
    """,
)
def time_granularity(t: Tables):
    return granularity(t.orders.select("o_orderdate"), "o_orderdate")


@query(
    "step_counts",
    """
    WITH d AS (SELECT date_diff('microsecond', lag(o_orderdate) OVER (ORDER BY o_orderdate), o_orderdate) / 1e6 AS step_seconds FROM orders)
    SELECT step_seconds, count(*) AS n FROM d WHERE step_seconds IS NOT NULL GROUP BY 1
    """,
)
def steps(t: Tables):
    return step_counts(t.orders.select("o_orderdate"), "o_orderdate")


# --- ranks, sorts, samples -----------------------------------------------------------------------


@query(
    "rank_avg",
    """
    SELECT p_partkey, p_size, CAST(floor(rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) AS BIGINT) AS avg_rank
    FROM part
    """,
)
def rank_avg(t: Tables):
    return profile.average_ranks(t.part.select("p_partkey", "p_size"), "p_size").select("p_partkey", "p_size", "avg_rank")


@query(
    "minmax_norm",
    """
    WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
    SELECT p_partkey, round((p_size - a) / CAST(b - a AS DOUBLE), 6) AS p_size_norm, round((p_retailprice - c) / (d - c), 6) AS p_retailprice_norm,
           round(((p_size - a) / CAST(b - a AS DOUBLE) + (p_retailprice - c) / (d - c)) / 2, 6) AS avg_norm FROM part, s
    """,
)
def minmax_norm(t: Tables):
    normed = explain.normalized_columns(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    average = (F.col("p_size_norm") + F.col("p_retailprice_norm")) / 2
    return normed.select("p_partkey", r6("p_size_norm"), r6("p_retailprice_norm"), r6(average, "avg_norm"))


@query(
    "topk_abs_z",
    """
    WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sigma FROM events)
    SELECT event_id, round((value - mu) / sigma, 6) AS z FROM events, s ORDER BY abs((value - mu) / sigma) DESC, event_id LIMIT 8
    """,
)
def topk_abs_z(t: Tables):
    scored = anomaly.zscore_anomalies(t.events.select("event_id", "value"), "value")
    return scored.orderBy(F.desc(F.abs("z")), "event_id").limit(8).select("event_id", r6("z"))


@query("head_n", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5")
def head_n(t: Tables):
    return t.events.select("event_id", "ts", "value").orderBy("ts", "event_id").limit(5)


@query(
    "hash_sample",
    """
    SELECT event_id, value FROM events
    ORDER BY ((event_id + 42) % 2147483648) * 2654435761 % 4294967296, event_id LIMIT 5000
    """,
)
def hash_sample(t: Tables):
    return anomaly.hash_sample(t.events.select("event_id", "value"), 5000, F.col("event_id"))


@query(
    "hash_split",
    """
    SELECT part, count(*) AS n, round(avg(l_extendedprice), 4) AS y FROM (
      SELECT l_extendedprice, CASE WHEN (l_orderkey % 2147483648) * 2654435761 % 4294967296 % 1000 < 200 THEN 'test' ELSE 'train' END AS part
      FROM lineitem) GROUP BY part
    """,
)
def hash_split(t: Tables):
    split = anomaly.hash_split(t.lineitem, F.col("l_orderkey"))
    return split.groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("l_extendedprice"), "y", 4))


# --- names ---------------------------------------------------------------------------------------

LINE_PAIRS = [(x, y) for x in ("l_quantity", "l_discount") for y in ("l_extendedprice", "l_tax", "l_linenumber")]


@query(
    "strip_prefix",
    " UNION ALL ".join(
        f"SELECT replace('{x}', 'l_', '') AS driver, replace('{y}', 'l_', '') AS measure, round(corr({x}, {y}), 6) AS correlation, "
        f"round(abs(corr({x}, {y})), 6) AS strength FROM lineitem"
        for x, y in LINE_PAIRS
    ),
)
def strip_prefix(t: Tables):
    pairs = profile.correlations(t.lineitem, LINE_PAIRS)
    named = joins.renamed(joins.without_part(pairs, ["x", "y"], "l_"), {"x": "driver", "y": "measure", "r": "correlation"})
    return named.select("driver", "measure", r6("correlation"), r6(F.abs("correlation"), "strength"))


# --- set operations ------------------------------------------------------------------------------


@query(
    "union_series",
    """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1),
         m AS (SELECT max(ds) AS last FROM d)
    SELECT ds, round(y, 6) AS y, 'history' AS part FROM d, m WHERE ds <= last - 30
    UNION ALL SELECT ds, round(y, 6), 'actual' FROM d, m WHERE ds > last - 30
    """,
)
def union_series(t: Tables):
    from obsflow.operators.series import split_cutoff

    split = split_cutoff(daily_mean(t.orders, "o_orderdate", "o_totalprice"), days=30)
    rows = {p: split.where(F.col("split") == s).select("ds", r6("y")) for p, s in (("history", "train"), ("actual", "test"))}
    return joins.stacked_parts(**rows)


@query(
    "union_distinct",
    "SELECT CAST(o_orderdate AS DATE) AS ds FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem",
)
def union_distinct(t: Tables):
    return joins.union_dates(
        t.orders.select(F.to_date("o_orderdate").alias("ds")), t.lineitem.select(F.to_date("l_shipdate").alias("ds"))
    )


# --- scalar functions ----------------------------------------------------------------------------


@query(
    "calendar_fields",
    """
    SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dayofweek, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear, CAST(week(o_orderdate) AS INTEGER) AS weekofyear FROM orders
    """,
)
def calendar_fields(t: Tables):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in scalar.calendar_fields("o_orderdate").items()])


@query(
    "cyclical",
    """
    SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
           round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS dow_cos
    FROM orders
    """,
)
def cyclical(t: Tables):
    return t.orders.select(
        "o_orderkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in scalar.cyclical_fields("o_orderdate").items()]
    )


@query(
    "clip",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 7 THEN NULL ELSE greatest(10.0, least(40.0, l_quantity)) END AS both_sides,
           CASE WHEN l_quantity = 7 THEN NULL ELSE least(40.0, l_quantity) END AS upper_only FROM lineitem
    """,
)
def clip(t: Tables):
    q = F.nullif("l_quantity", F.lit(7.0))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        scalar.clip(q, 10.0, 40.0).alias("both_sides"), scalar.clip(q, upper=40.0).alias("upper_only"),
    )


@query(
    "standardize",
    """
    WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 7.0) AS q FROM lineitem), m AS (SELECT median(q) AS med FROM h),
         s AS (SELECT avg(coalesce(q, med)) AS mu, stddev_pop(coalesce(q, med)) AS sd FROM h, m)
    SELECT l_orderkey, l_linenumber, l_partkey, round((coalesce(q, med) - mu) / sd, 6) AS scaled FROM h, m, s
    """,
)
def standardize(t: Tables):
    h = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_quantity", F.lit(7.0)).alias("q"))
    p = anomaly.fit_params(h, ["q"], "q")
    scaled = scalar.standardize("q", F.lit(p["medians"][0]), F.lit(p["mean"][0]), F.lit(p["scale"][0]))
    return h.select("l_orderkey", "l_linenumber", "l_partkey", r6(scaled, "scaled"))


@query(
    "avg_path_length",
    """
    SELECT l_suppkey, n, round(CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
        ELSE 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / CAST(n AS DOUBLE) END, 6) AS c
    FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
    """,
)
def avg_path_length(t: Tables):
    sizes = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return sizes.select("l_suppkey", "n", r6(scalar.average_path_length(F.col("n")), "c"))


@query(
    "json_props",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS nested FROM events
    """,
)
def json_props(t: Tables):
    nested = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), nested.alias("nested"))
