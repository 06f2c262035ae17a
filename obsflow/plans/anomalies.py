"""Anomaly detection on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.functions import scalar
from obsflow.operators import anomaly, joins
from obsflow.plans.catalog import Tables, query, r6

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Two plain detectors on one table stand in for the two methods where SQL has to agree.
FLAGS = """s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2 FROM lineitem),
  flags AS (SELECT l_orderkey, l_linenumber, l_partkey, abs((l_extendedprice - m1) / s1) > 1.5 AS a, abs((l_quantity - m2) / s2) > 1.5 AS b FROM lineitem, s)"""


def flags(t: Tables) -> DataFrame:
    first = anomaly.zscore_anomalies(t.lineitem, "l_extendedprice", threshold=1.5)
    first = first.withColumnRenamed("anomaly_zscore", "a")
    return anomaly.zscore_anomalies(first, "l_quantity", threshold=1.5).withColumnRenamed("anomaly_zscore", "b")


@query(
    "zscore",
    """
    WITH s AS (SELECT avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sigma FROM events)
    SELECT event_id, round((value - mu) / sigma, 6) AS z, abs((value - mu) / sigma) > 3 AS anomaly_zscore FROM events, s
    """,
)
def zscore(t: Tables):
    return anomaly.zscore_anomalies(t.events.select("event_id", "value"), "value").select("event_id", r6("z"), "anomaly_zscore")


@query(
    "zscore_by_group",
    """
    WITH s AS (SELECT event_type, avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sigma FROM events GROUP BY 1)
    SELECT event_id, event_type, round((value - mu) / sigma, 6) AS z, abs((value - mu) / sigma) > 3 AS anomaly_zscore
    FROM events JOIN s USING (event_type)
    """,
)
def zscore_by_group(t: Tables):
    scored = anomaly.zscore_anomalies(t.events.select("event_id", "event_type", "value"), "value", by=["event_type"])
    return scored.select("event_id", "event_type", r6("z"), "anomaly_zscore")


@query(
    "anomaly_label",
    f"""WITH {FLAGS} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'zscore_only' WHEN b THEN 'if_only' ELSE 'normal' END AS label,
    CASE WHEN a AND b THEN 'both' WHEN a THEN 'zscore' ELSE 'isolation_forest' END AS detected_by FROM flags""",
)
def anomaly_label(t: Tables):
    a, b = F.col("a"), F.col("b")
    return flags(t).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        scalar.anomaly_label(a, b).alias("label"), scalar.detected_by(a, b).alias("detected_by"),
    )


@query("overlap", f"WITH {FLAGS} SELECT count(*) FILTER (WHERE a AND b) AS overlap FROM flags")
def overlap(t: Tables):
    return anomaly.overlap_count(flags(t), "a", "b")


@query(
    "method_comparison",
    f"""WITH {FLAGS}, l AS (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'zscore_only' WHEN b THEN 'if_only' ELSE 'neither' END AS label FROM flags)
    SELECT label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM l), 6) AS share_pct FROM l GROUP BY label""",
)
def method_comparison(t: Tables):
    return anomaly.method_comparison(flags(t), "a", "b").withColumn("share_pct", r6("share_pct"))


@query(
    "method_summary",
    f"""WITH {FLAGS} SELECT CAST(1.5 AS DOUBLE) AS z_threshold, count(*) FILTER (WHERE a) AS z_count, round(100.0 * count(*) FILTER (WHERE a) / count(*), 6) AS z_share_pct,
    CAST(0.02 AS DOUBLE) AS if_contamination, count(*) FILTER (WHERE b) AS if_count, round(100.0 * count(*) FILTER (WHERE b) / count(*), 6) AS if_share_pct,
    count(*) FILTER (WHERE a AND b) AS overlap_count FROM flags""",
)
def method_summary(t: Tables):
    summary = anomaly.method_summary(flags(t), threshold=1.5, contamination=0.02, a="a", b="b")
    return summary.withColumns({c: r6(c) for c in ("z_share_pct", "if_share_pct")})


@query(
    "flag_sets",
    f"""WITH {FLAGS}, d AS (SELECT l_orderkey, l_linenumber, bool_or(a) AS a, bool_or(b) AS b FROM flags GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, CASE WHEN a AND b THEN 'both' WHEN a THEN 'zscore_only' WHEN b THEN 'if_only' ELSE 'neither' END AS segment FROM d""",
)
def flag_sets(t: Tables):
    rows = flags(t)
    return joins.flagged_sets(rows.where("a"), rows.where("b"), rows, ["l_orderkey", "l_linenumber"])


@query(
    "detector_counts",
    f"""WITH {FLAGS} SELECT 'zscore' AS feature, count(*) FILTER (WHERE a) AS n FROM flags UNION ALL SELECT 'isolation_forest', count(*) FILTER (WHERE b) FROM flags
    UNION ALL SELECT 'either', count(*) FILTER (WHERE a OR b) FROM flags""",
)
def detector_counts(t: Tables):
    from obsflow.operators.profile import unpivoted

    a, b = F.col("a"), F.col("b")
    row = flags(t).agg(F.count_if(a).alias("z"), F.count_if(b).alias("i"), F.count_if(a | b).alias("any"))
    names = {"zscore": "z", "isolation_forest": "i", "either": "any"}
    return unpivoted(row, {k: {"n": F.col(c)} for k, c in names.items()})


RECORDS_SQL = """
    WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sigma FROM events),
    z AS (SELECT e.*, (value - mu) / sigma AS z FROM events e, s)
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS country, CAST(user_id AS DOUBLE) AS lat, CAST(event_id AS DOUBLE) AS lon,
           value AS temp_c, round(z, 6) AS z, CASE WHEN abs(z) > 3 AND user_id > 75 THEN 'both' WHEN abs(z) > 3 THEN 'zscore' ELSE 'isolation_forest' END AS detected_by
    FROM z WHERE abs(z) > 3 OR (user_id > 75 AND value > 60)
"""


def flagged_events(t: Tables) -> DataFrame:
    scored = anomaly.zscore_anomalies(t.events, "value")
    other = (F.col("user_id") > 75) & ((F.col("value") > 60) | F.col("anomaly_zscore"))
    return scored.withColumns({"anomaly_if": other, "if_score": F.lit(-0.5), "z": F.round("z", 6)})


@query("anomaly_records", RECORDS_SQL.replace("round(z, 6) AS z,", "CAST(round(round(z, 6), 3) AS DOUBLE) AS z, -0.5::DOUBLE AS if_score,"))
def anomaly_records(t: Tables):
    rows = flagged_events(t)
    return anomaly.anomaly_records(
        rows, ts="ts", country=F.col("event_type"), lat=F.col("user_id").cast("double"),
        lon=F.col("event_id").cast("double"), temp=F.col("value"),
    )


PHRASE_SQL = """CASE WHEN abs(z) >= 3 THEN 'a severe' WHEN abs(z) >= 2 THEN 'a notable' ELSE 'an' END || ' ' ||
    CASE WHEN t >= 38 THEN 'scorching, extreme heat' WHEN t >= 30 THEN 'very hot' WHEN t >= 22 THEN 'warm' WHEN t <= -12 THEN 'freezing, extreme cold'
         WHEN t <= 0 THEN 'very cold' WHEN t <= 10 THEN 'cold' ELSE 'mild' END || ' temperature anomaly'"""


@query(
    "render_record",
    f"""
    WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sigma FROM events),
    z AS (SELECT event_id, ts, event_type, value - 20 AS t, (value - mu) / sigma AS z FROM events, s)
    SELECT event_id, 'On ' || strftime(ts, '%Y-%m-%d') || ', ' || event_type || ' experienced ' || {PHRASE_SQL} || ': temperature ' ||
      printf('%.2f', t) || 'C, z-score ' || CASE WHEN z >= 0 THEN 'high' ELSE 'low' END || ', detected by zscore.' AS text FROM z
    """,
)
def render_record(t: Tables):
    scored = anomaly.zscore_anomalies(t.events, "value")
    # Texts of doubles differ between engines: the sentence is checked with fixed-point numbers.
    temp = F.col("value") - 20
    text = scalar.render_record(F.col("ts"), F.col("event_type"), temp, F.col("z"), F.lit("zscore"))
    sign = F.when(F.col("z") >= 0, "high").otherwise("low")
    text = F.regexp_replace(text, r"temperature \S+C, z-score [^,]+,", "temperature #C, z-score @,")
    text = F.replace(F.replace(text, F.lit("#"), F.format_string("%.2f", temp)), F.lit("@"), sign)
    return scored.select("event_id", text.alias("text"))


# --- isolation forest ----------------------------------------------------------------------------


@query("iforest")
def iforest(t: Tables):
    scored, _ = anomaly.isolation_forest(t.lineitem.select(*dict.fromkeys([*IDS, *FEATURES])), FEATURES, id_cols=IDS)
    return scored.select(*IDS, "if_score", "anomaly_if")


@query("forest_table")
def forest_table(t: Tables):
    model = anomaly.fit_anomaly_models(t.lineitem, features=FEATURES, id_cols=IDS)
    return model.forest(t.spark)


PARAMS = ["l_quantity", "l_extendedprice", "l_discount"]


ANOMALY_PARAMS_SQL = (
    """WITH h AS (SELECT nullif(l_quantity, 7.0) AS l_quantity, l_extendedprice, l_discount FROM lineitem),
    z AS (SELECT avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sigma FROM h), """
    + ", ".join(
        f"f{i} AS (SELECT '{c}' AS feature, m AS median, avg(coalesce({c}, m)) AS mean, stddev_pop(coalesce({c}, m)) AS scale, min({c}) AS min, max({c}) AS max"
        f" FROM h, (SELECT median({c}) AS m FROM h) GROUP BY m)"
        for i, c in enumerate(PARAMS)
    )
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(PARAMS)))
    + """) SELECT feature, round(median, 6) AS median, round(mean, 7) AS mean, round(scale, 5) AS scale, min, max, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
    3.0::DOUBLE AS threshold, CAST(256 AS INTEGER) AS max_samples FROM u, z"""
)


def holed_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))


@query("anomaly_params", ANOMALY_PARAMS_SQL)
def anomaly_params(t: Tables):
    model = anomaly.fit_anomaly_models(holed_lines(t), features=PARAMS, id_cols=IDS)
    table = model.params(t.spark)
    digits = {"median": 6, "mean": 7, "scale": 5, "mu": 6, "sigma": 6}
    return table.select("feature", *[r6(c, digits=d) for c, d in digits.items()], "min", "max", "threshold", "max_samples")


# Two small fixed trees, so that SQL can follow the walk.
FIXED_TREES = [
    {"tree_id": 0, "feature": [0, -2, 1, -2, -2], "threshold": [10.0, -2.0, 50000.0, -2.0, -2.0], "children_left": [1, -1, 3, -1, -1],
     "children_right": [2, -1, 4, -1, -1], "n_node_samples": [256, 40, 216, 100, 116]},
    {"tree_id": 1, "feature": [1, 0, -2, -2, -2], "threshold": [90000.0, 45.0, -2.0, -2.0, -2.0], "children_left": [1, 3, -1, -1, -1],
     "children_right": [2, 4, -1, -1, -1], "n_node_samples": [256, 230, 26, 200, 30]},
]
C_SQL = "(2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}.0)"


def c_sql(n: int) -> str:
    return C_SQL.format(n=n)


def fixed_model() -> anomaly.AnomalyModel:
    two = [0.0, 0.0]
    return anomaly.AnomalyModel(
        ["l_quantity", "l_extendedprice"], [25.0, 50000.0], two, [1.0, 1.0], two, two, 25.0, 14.0, 256, FIXED_TREES, offset=-0.52, threshold=1.5
    )


FIXED_SQL = f"""
    x AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_quantity, 7.0), 25.0) AS q, nullif(l_quantity, 7.0) AS raw, l_extendedprice AS p FROM lineitem),
    d AS (SELECT *, CASE WHEN q <= 10 THEN 1 + {c_sql(40)} WHEN p <= 50000 THEN 2 + {c_sql(100)} ELSE 2 + {c_sql(116)} END AS d0,
       CASE WHEN p > 90000 THEN 1 + {c_sql(26)} WHEN q <= 45 THEN 2 + {c_sql(200)} ELSE 2 + {c_sql(30)} END AS d1 FROM x),
    scored AS (SELECT *, -pow(2.0, -((d0 + d1) / 2) / {c_sql(256)}) AS score, (coalesce(raw, 25.0) - 25.0) / 14.0 AS z FROM d)"""


@query("forest_score", f"WITH {FIXED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) AS if_score, score < -0.52 AS anomaly_if FROM scored")
def forest_score(t: Tables):
    rows = t.lineitem.select(*IDS, "l_extendedprice", F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"))
    judged = fixed_model().verdicts(rows, temperature="l_quantity")
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", r6("if_score"), "anomaly_if")


@query("zscore_model", f"WITH {FIXED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(z, 6) AS z, abs(z) > 1.5 AS anomaly_zscore FROM scored")
def zscore_model(t: Tables):
    rows = t.lineitem.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    judged = anomaly.zscore_with_params(rows, "l_quantity", 25.0, 14.0, threshold=1.5)
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", r6("z"), "anomaly_zscore")
