"""Cleaning steps and the full preparation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsflow.operators import prep
from obsflow.plans.catalog import Tables, query, r6

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
# The test tables have no nulls: both engines blank the same values.
HOLED = """h AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 7.0) AS l_quantity, l_extendedprice,
    nullif(l_discount, 0.05) AS l_discount, l_tax, nullif(l_returnflag, 'A') AS l_returnflag FROM lineitem)"""
FILLED = HOLED + """, md AS (SELECT l_returnflag AS flag FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  med AS (SELECT median(l_quantity) AS mq, median(l_extendedprice) AS me, median(l_discount) AS mdi, median(l_tax) AS mt FROM h),
  f AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, mq) AS l_quantity, coalesce(l_extendedprice, me) AS l_extendedprice,
        coalesce(l_discount, mdi) AS l_discount, coalesce(l_tax, mt) AS l_tax, coalesce(l_returnflag, flag) AS l_returnflag FROM h, med, md)"""


def holed(t: Tables):
    return t.lineitem.select(
        *IDS,
        F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"),
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        "l_tax",
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"),
    )


@query("impute", f"WITH {FILLED} SELECT * FROM f")
def impute(t: Tables):
    return prep.impute_missing_values(holed(t), [*NUM, "absent"], ["l_returnflag"])


BOUNDS = "SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}"
FENCES = "SELECT feature, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM b WHERE q3 <> q1"
# A zero-inflated column has equal quartiles and must get no fence.
ZERO = "CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0.0 END"


@query(
    "iqr_bounds",
    f"WITH x AS (SELECT *, {ZERO} AS zero_inflated FROM lineitem), b AS ("
    + " UNION ALL ".join(BOUNDS.format(c=c, src="x") for c in [*NUM, "zero_inflated"])
    + f") {FENCES}",
)
def iqr_bounds(t: Tables):
    zero = F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0.0)
    table = t.lineitem.withColumn("zero_inflated", zero)
    return prep.iqr_bounds(table, [*NUM, "zero_inflated"]).select("feature", r6("lower"), r6("upper"))


@query(
    "iqr_clip",
    """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)), 6) AS value FROM events, b
    """,
)
def iqr_clip(t: Tables):
    events = t.events.select("event_id", "value")
    clipped = prep.treat_outliers_iqr(events, prep.detect_outliers_iqr(events, ["value"]))
    return clipped.select("event_id", r6("value"))


@query(
    "minmax_scale",
    """
    WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_tax - c) / (d - c), 6) AS l_tax,
           l_discount, 0.0 AS constant FROM lineitem, s
    """,
)
def minmax_scale(t: Tables):
    table = t.lineitem.select(*IDS, "l_quantity", "l_tax", "l_discount").withColumn("constant", F.lit(5.0))
    scaled, _ = prep.normalize_numeric_features(table, ["l_quantity", "l_tax", "l_discount", "constant"], ["l_discount"])
    return scaled.select(*IDS, r6("l_quantity"), r6("l_tax"), "l_discount", "constant")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(f"c_mktsegment = '{s}' AND c_custkey <> 7 AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + " FROM customer",
)
def one_hot(t: Tables):
    table = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") != 7, F.col("c_mktsegment")).alias("c_mktsegment"))
    return prep.encode_categorical_features(table, ["c_name", "c_mktsegment"], 50)


PREP_SQL = (
    f"WITH {FILLED}, b AS (SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c},"
        f" quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in NUM
    )
    + " FROM f), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, "
    + ", ".join(f"greatest(lo_{c}, least(hi_{c}, {c})) AS {c}" for c in NUM)
    + " FROM f, b), s AS (SELECT "
    + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in NUM)
    + " FROM c) SELECT "
    + "CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_partkey AS DOUBLE) AS l_partkey, "
    + ", ".join(f"round(({c} - mn_{c}) / (mx_{c} - mn_{c}), 6) AS {c}" for c in NUM)
    + ", l_returnflag = 'N' AS \"l_returnflag_N\", l_returnflag = 'R' AS \"l_returnflag_R\" FROM c, s"
)


@query("prep_full", PREP_SQL)
def prep_full(t: Tables):
    clean, _ = prep.run_preprocessing(holed(t), exclude_from_normalize=IDS)
    return clean.select(*[r6(c) if c in NUM else c for c in clean.columns])


@query(
    "prep_transform",
    """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS y, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT *, row_number() OVER (ORDER BY ds DESC) <= 30 AS test FROM d),
    q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b, quantile_cont(n, 0.25) AS c, quantile_cont(n, 0.75) AS e FROM s WHERE NOT test),
    k AS (SELECT ds, test, greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), y)) AS y, greatest(c - 1.5 * (e - c), least(e + 1.5 * (e - c), n)) AS n FROM s, q),
    m AS (SELECT min(y) AS y0, max(y) AS y1, min(n) AS n0, max(n) AS n1 FROM k WHERE NOT test)
    SELECT ds, round((y - y0) / (y1 - y0), 6) AS y, round((n - n0) / (n1 - n0), 6) AS n FROM k, m WHERE test
    """,
)
def prep_transform(t: Tables):
    from obsflow.operators.series import split_tail

    daily = t.orders.groupBy(F.lit("global").alias("key"), F.to_date("o_orderdate").alias("ds")).agg(
        F.avg("o_totalprice").alias("y"), F.count("*").alias("n")
    )
    split = split_tail(daily, test=30)
    model = prep.fit_prep(split.where("split = 'train'").select("ds", "y", "n"))
    return model.transform(split.where("split = 'test'").select("ds", "y", "n")).select("ds", r6("y"), r6("n"))


@query(
    "prep_report",
    f"WITH {FILLED}, b AS ("
    + " UNION ALL ".join(BOUNDS.format(c=c, src="f") for c in [*IDS, *NUM])
    + "), n AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after FROM h" for c in [*IDS, *NUM, "l_returnflag"]
    )
    + "), o AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers"
        f" FROM h, b WHERE b.feature = '{c}' AND q1 <> q3"
        for c in [*IDS, *NUM]
    )
    + ") SELECT feature, nulls_before, nulls_after, outliers FROM n LEFT JOIN o USING (feature)",
)
def prep_report(t: Tables):
    before = holed(t)
    clean, model = prep.run_preprocessing(before, exclude_from_normalize=IDS)
    return prep.prep_report(before, clean, model)
