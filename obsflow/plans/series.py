"""Daily series, their features, splits, scores, intervals and drift on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.operators import conformal, drift, evaluate
from obsflow.operators import series as ops
from obsflow.plans.catalog import Tables, query, r6
from obsflow.session import checkpointed

# Building blocks of the SQL side.
DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1)"
SPLIT = """split AS (SELECT *, CASE WHEN back <= 30 THEN 'test' WHEN back <= 60 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY ds DESC) AS back FROM daily))"""
NAIVE = """feats AS (SELECT ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7,
        CASE WHEN count(y) OVER p7 = 7 THEN avg(y) OVER p7 END AS mean_7
    FROM daily WINDOW w AS (ORDER BY ds), p7 AS (ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
  preds AS (SELECT ds, y, 'lag_1' AS model_id, lag_1 AS y_hat FROM feats UNION ALL SELECT ds, y, 'lag_7', lag_7 FROM feats
    UNION ALL SELECT ds, y, 'mean_7', mean_7 FROM feats)"""
SCORED = """metrics AS (SELECT split, model_id, sqrt(avg((y - y_hat) ** 2)) AS rmse_c, avg(abs(y - y_hat)) AS mae_c,
      avg(CASE WHEN y <> 0 THEN abs((y - y_hat) / y) END) * 100 AS mape_pct
    FROM (SELECT preds.*, split.split FROM preds JOIN split USING (ds)) WHERE y_hat IS NOT NULL GROUP BY 1, 2),
  weights AS (SELECT model_id, (1 / rmse_c) / sum(1 / rmse_c) OVER () AS weight FROM metrics WHERE split = 'val')"""
BASE = f"WITH {DAILY}, {SPLIT}, {NAIVE}, {SCORED}"


def orders_daily(t: Tables) -> DataFrame:
    return ops.daily_mean(t.orders, "o_orderdate", "o_totalprice")


def naive_predictions(series: DataFrame) -> DataFrame:
    """Three forecasts that only look back: ``(key, ds, y, model_id, y_hat)``."""
    columns = {**ops.lag_columns([1, 7]), "mean_7": ops.rolling_columns([7])["rolling_mean_7"]}
    wide = series.withColumns(columns)
    return wide.unpivot(["key", "ds", "y"], list(columns), "model_id", "y_hat")


def scored_naive(t: Tables) -> DataFrame:
    daily = orders_daily(t)
    split = ops.split_tail(daily, test=30, val=30).select("key", "ds", "split")
    return naive_predictions(daily).join(split, ["key", "ds"]).where(F.col("y_hat").isNotNull())


def naive_metrics(t: Tables, part: str) -> DataFrame:
    return evaluate.compute_metrics(scored_naive(t).where(F.col("split") == part))


def rounded_metrics(metrics: DataFrame, *extra) -> DataFrame:
    return metrics.select("model_id", *[r6(c, digits=5) for c in ("rmse_c", "mae_c", "mape_pct")], *extra)


@query("daily_mean", f"WITH {DAILY} SELECT ds, round(y, 6) AS y FROM daily")
def daily_mean(t: Tables):
    return orders_daily(t).select("ds", r6("y"))


@query(
    "daily_mean_by_type",
    "SELECT event_type AS key, CAST(ts AS DATE) AS ds, round(avg(value), 6) AS y FROM events GROUP BY 1, 2",
)
def daily_mean_by_type(t: Tables):
    return ops.daily_mean(t.events, "ts", "value", key="event_type").select("key", "ds", r6("y"))


@query(
    "lags",
    f"WITH {DAILY} SELECT ds, "
    + ", ".join(f"round(lag(y, {k}) OVER (ORDER BY ds), 6) AS lag_{k}" for k in ops.DEFAULT_LAGS)
    + " FROM daily",
)
def lags(t: Tables):
    cols = ops.lag_columns(ops.DEFAULT_LAGS)
    return orders_daily(t).select("ds", *[r6(c, n) for n, c in cols.items()])


def rolling_sql(w: int, alias: str = "") -> str:
    return (
        f"round(CASE WHEN count(y) OVER p{w} = {w} THEN avg(y) OVER p{w} END, 5) AS rolling_mean_{w},"
        f" round(CASE WHEN count(y) OVER p{w} = {w} THEN stddev_samp(y) OVER p{w} END, 4) AS rolling_std_{w}"
    )


WINDOWS = ", ".join(
    f"p{w} AS (ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in ops.DEFAULT_ROLLING_WINDOWS
)


def rounded_rolling(cols) -> list:
    return [r6(c, n, 5 if "mean" in n else 4) for n, c in cols]


@query(
    "rolling_stats",
    f"WITH {DAILY} SELECT ds, " + ", ".join(rolling_sql(w) for w in ops.DEFAULT_ROLLING_WINDOWS) + f" FROM daily WINDOW {WINDOWS}",
)
def rolling_stats(t: Tables):
    cols = ops.rolling_columns(ops.DEFAULT_ROLLING_WINDOWS)
    return orders_daily(t).select("ds", *rounded_rolling(cols.items()))


@query(
    "create_features",
    f"WITH {DAILY} SELECT ds, round(y, 6) AS y, "
    + ", ".join(f"round(lag(y, {k}) OVER (ORDER BY ds), 6) AS lag_{k}" for k in ops.DEFAULT_LAGS)
    + ", "
    + ", ".join(rolling_sql(w) for w in ops.DEFAULT_ROLLING_WINDOWS)
    + """, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(month(ds) AS INTEGER) AS month, CAST(dayofyear(ds) AS INTEGER) AS dayofyear,
    CAST(week(ds) AS INTEGER) AS weekofyear, round(sin(2 * pi() * month(ds) / 12), 6) + 0.0 AS month_sin,
    round(cos(2 * pi() * month(ds) / 12), 6) + 0.0 AS month_cos, round(sin(2 * pi() * (isodow(ds) - 1) / 7), 6) + 0.0 AS dow_sin,
    round(cos(2 * pi() * (isodow(ds) - 1) / 7), 6) + 0.0 AS dow_cos """
    + f" FROM daily WINDOW {WINDOWS}",
)
def create_features(t: Tables):
    f = ops.create_features(orders_daily(t))
    lag_names = [f"lag_{k}" for k in ops.DEFAULT_LAGS]
    rolling = [(c, F.col(c)) for c in f.columns if c.startswith("rolling")]
    circle = [(F.round(c, 6) + 0.0).alias(c) for c in ("month_sin", "month_cos", "dow_sin", "dow_cos")]
    return f.select(
        "ds", r6("y"), *[r6(c) for c in lag_names], *rounded_rolling(rolling),
        "dayofweek", "month", "dayofyear", "weekofyear", *circle,
    )


@query(
    "ts_diff",
    """
    SELECT event_id, user_id, round(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6, 6) AS step_seconds
    FROM events
    """,
)
def ts_diff(t: Tables):
    rows = ops.with_previous(t.events.select("event_id", "user_id", "ts"), "ts", by=["user_id"], tie=["event_id"])
    step = ops.seconds_between(F.col("ts"), F.col("previous"))
    return rows.select("event_id", "user_id", r6(step, "step_seconds"))


@query("split_tail", f"WITH {DAILY}, {SPLIT} SELECT ds, split FROM split")
def split_tail(t: Tables):
    return ops.split_tail(orders_daily(t), test=30, val=30).select("ds", "split")


@query(
    "split_cutoff",
    """
    WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, avg(value) AS y FROM events GROUP BY 1, 2)
    SELECT key, ds, CASE WHEN ds > max(ds) OVER (PARTITION BY key) - 7 THEN 'test' ELSE 'train' END AS split FROM d
    """,
)
def split_cutoff(t: Tables):
    daily = ops.daily_mean(t.events, "ts", "value", key="event_type")
    return ops.split_cutoff(daily, days=7).select("key", "ds", "split")


@query(
    "cap_per_group",
    """
    SELECT event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 200
    """,
)
def cap_per_group(t: Tables):
    return ops.first_per_group(t.events, ["event_type"], ["ts", "event_id"], 200).select("event_type", "event_id", "value")


@query("tail_n", f"WITH {DAILY} SELECT ds, round(y, 6) AS y FROM daily ORDER BY ds DESC LIMIT 90")
def tail_n(t: Tables):
    return ops.last_rows(orders_daily(t), 90).select("ds", r6("y"))


@query(
    "drift_windows",
    f"""WITH {DAILY}, {SPLIT} SELECT ds, round(y, 6) AS y, CASE WHEN back <= 30 THEN 'current' ELSE 'reference' END AS part
    FROM split WHERE back <= 60""",
)
def drift_windows(t: Tables):
    return ops.adjacent_windows(orders_daily(t), 30).select("ds", r6("y"), "part")


ACF_LAGS = 40


@query(
    "acf",
    f"""WITH {DAILY}, n AS (SELECT row_number() OVER (ORDER BY ds) AS i, y - avg(y) OVER () AS d FROM daily),
    k AS (SELECT CAST(unnest(range(0, {ACF_LAGS + 1})) AS INTEGER) AS lag)
    SELECT k.lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM n), 6) AS acf
    FROM k JOIN n a ON TRUE JOIN n b ON b.i = a.i - k.lag GROUP BY 1""",
)
def acf(t: Tables):
    return ops.autocorrelation(orders_daily(t), ACF_LAGS).select("lag", r6("acf"))


# --- scores and ensembles ------------------------------------------------------------------------


@query(
    "error_metrics",
    BASE + " SELECT split, model_id, round(rmse_c, 5) AS rmse_c, round(mae_c, 5) AS mae_c, round(mape_pct, 5) AS mape_pct FROM metrics",
)
def error_metrics(t: Tables):
    metrics = evaluate.compute_metrics(scored_naive(t), by=["split", "model_id"])
    return rounded_metrics(metrics, "split")


@query("inverse_rmse_weights", BASE + " SELECT model_id, round(weight, 6) AS weight FROM weights")
def inverse_rmse_weights(t: Tables):
    return evaluate.inverse_rmse_weights(naive_metrics(t, "val")).select("model_id", r6("weight"))


@query(
    "ensemble_weighted",
    BASE + """ SELECT ds, round(sum(weight * y_hat), 5) AS y_hat FROM preds JOIN split USING (ds) JOIN weights USING (model_id)
    WHERE split = 'test' GROUP BY ds""",
)
def ensemble_weighted(t: Tables):
    scored = scored_naive(t)
    weights = evaluate.inverse_rmse_weights(evaluate.compute_metrics(scored.where("split = 'val'")))
    test = scored.where("split = 'test'").select("key", "ds", "model_id", "y_hat")
    return evaluate.weighted_ensemble(test, weights).select("ds", r6("y_hat", digits=5))


@query(
    "ensemble_simple",
    BASE + " SELECT ds, round(avg(y_hat), 5) AS y_hat FROM preds JOIN split USING (ds) WHERE split = 'test' GROUP BY ds",
)
def ensemble_simple(t: Tables):
    test = scored_naive(t).where("split = 'test'").select("key", "ds", "model_id", "y_hat")
    return evaluate.simple_average(test).select("ds", r6("y_hat", digits=5))


ENSEMBLES = """,
  ens AS (SELECT ds, any_value(p.y) AS y, 'ensemble_simple' AS model_id, avg(y_hat) AS y_hat FROM preds p JOIN split USING (ds) WHERE split = 'test' GROUP BY ds
    UNION ALL SELECT ds, any_value(p.y), 'ensemble_weighted', sum(weight * y_hat) FROM preds p JOIN split USING (ds) JOIN weights USING (model_id)
    WHERE split = 'test' GROUP BY ds),
  ens_metrics AS (SELECT model_id, sqrt(avg((y - y_hat) ** 2)) AS rmse_c, avg(abs(y - y_hat)) AS mae_c, avg(abs((y - y_hat) / y)) * 100 AS mape_pct FROM ens GROUP BY 1),
  everything AS (SELECT model_id, rmse_c, mae_c, mape_pct FROM metrics WHERE split = 'test' UNION ALL SELECT * FROM ens_metrics)"""


def naive_run(t: Tables) -> dict[str, DataFrame]:
    from obsflow.plans.forecast_run import score_run

    scored = checkpointed(scored_naive(t))
    shape = ("key", "ds", "model_id", "y_hat")
    return score_run(
        scored.where("split = 'test'").select(*shape), scored.where("split = 'val'").select(*shape), orders_daily(t)
    )


@query(
    "leakage_free_naive",
    BASE + ENSEMBLES + """ SELECT model_id, round(rmse_c, 5) AS rmse_c, round(mae_c, 5) AS mae_c, round(mape_pct, 5) AS mape_pct,
    round(weight, 6) AS ensemble_weight FROM everything LEFT JOIN weights USING (model_id)""",
)
def leakage_free_naive(t: Tables):
    return rounded_metrics(naive_run(t)["metrics"], r6("ensemble_weight"))


BASELINE_ROW = "SELECT 'daily_level' AS model_id, avg(abs(y - m)) AS rmse_c FROM daily, (SELECT avg(y) AS m FROM daily)"


@query(
    "leaderboard",
    BASE + f""", rows AS (SELECT model_id, rmse_c FROM metrics WHERE split = 'test' UNION ALL {BASELINE_ROW})
    SELECT model_id, round(rmse_c, 5) AS rmse_c, CAST(row_number() OVER (ORDER BY rmse_c, model_id) AS INTEGER) AS place FROM rows""",
)
def leaderboard(t: Tables):
    daily = orders_daily(t)
    level = daily.agg(F.avg("y")).scalar()
    outside = daily.agg(F.avg(F.abs(F.col("y") - level)).alias("rmse_c")).select(
        F.lit(ops.GLOBAL_KEY).alias("key"), F.lit("daily_level").alias("model_id"), "rmse_c"
    )
    board = evaluate.leaderboard(naive_metrics(t, "test").select("key", "model_id", "rmse_c"), outside)
    return board.select("model_id", r6("rmse_c", digits=5), "place")


@query(
    "best_model",
    BASE + """ SELECT (SELECT model_id FROM metrics WHERE split = 'test' ORDER BY rmse_c, model_id LIMIT 1) AS best_id,
    round(min(rmse_c), 5) AS best_rmse, round(max(rmse_c), 5) AS max_rmse FROM metrics WHERE split = 'test'""",
)
def best_model(t: Tables):
    final = naive_metrics(t, "test").withColumn("status", F.lit("final"))
    return evaluate.best_model(final).select("best_id", r6("best_rmse", digits=5), r6("max_rmse", digits=5))


@query(
    "union_all",
    BASE + """ SELECT model_id, split, round(rmse_c, 5) AS rmse_c FROM metrics WHERE split = 'val'
    UNION ALL SELECT model_id, split, round(rmse_c, 5) FROM metrics WHERE split = 'test'""",
)
def union_all(t: Tables):
    from obsflow.operators.joins import stacked_parts

    parts = stacked_parts(val=naive_metrics(t, "val"), test=naive_metrics(t, "test"))
    return parts.select("model_id", F.col("part").alias("split"), r6("rmse_c", digits=5))


@query(
    "rolling_origin",
    f"""WITH {DAILY}, b AS (SELECT *, row_number() OVER (ORDER BY ds DESC) AS back FROM daily),
    o AS (SELECT unnest(range(0, 5)) AS origin),
    r AS (SELECT origin, ds, y, back - origin * 30 AS step, CASE WHEN back <= (origin + 1) * 30 THEN 'test' ELSE 'train' END AS split
          FROM b, o WHERE back > origin * 30),
    l AS (SELECT origin, avg(y) AS y_hat FROM r WHERE split = 'train' AND step <= 37 GROUP BY origin)
    SELECT CAST(origin AS INTEGER) AS origin, count(*) AS n, round(sqrt(avg((y - y_hat) ** 2)), 5) AS rmse_c
    FROM r JOIN l USING (origin) WHERE split = 'test' GROUP BY origin""",
)
def rolling_origin(t: Tables):
    from pyspark.sql import Window as W

    from obsflow.plans.forecast_run import rolling_origins

    rows = rolling_origins(orders_daily(t), origins=5, horizon=30)
    train = rows.where("split = 'train'").withColumn(
        "back", F.row_number().over(W.partitionBy("key", "origin").orderBy(F.desc("ds")))
    )
    level = train.where("back <= 7").groupBy("key", "origin").agg(F.avg("y").alias("y_hat"))
    scored = rows.where("split = 'test'").join(level, ["key", "origin"])
    metrics = evaluate.compute_metrics(scored, by=["key", "origin"])
    sizes = scored.groupBy("key", "origin").agg(F.count("*").alias("n"))
    return metrics.join(sizes, ["key", "origin"]).select("origin", "n", r6("rmse_c", digits=5))


# --- conformal intervals -------------------------------------------------------------------------

CONFORMAL = """,
  res AS (SELECT model_id, abs(y - y_hat) AS residual FROM preds JOIN split USING (ds) WHERE split <> 'test' AND y_hat IS NOT NULL),
  ranked AS (SELECT model_id, residual, row_number() OVER (PARTITION BY model_id ORDER BY residual) AS k, count(*) OVER (PARTITION BY model_id) AS n FROM res),
  q AS (SELECT model_id, n, residual AS q FROM ranked WHERE k = least(n, greatest(1, CAST(ceil((n + 1) * (1 - CAST(0.1 AS DOUBLE))) AS BIGINT)))),
  bands AS (SELECT ds, p.y, model_id, y_hat - q AS lower, y_hat + q AS upper FROM preds p JOIN split USING (ds) JOIN q USING (model_id) WHERE split = 'test')"""
# The preds table has its own y column; the split table repeats it.
CONFORMAL = CONFORMAL.replace("abs(y - y_hat) AS residual FROM preds JOIN", "abs(preds.y - y_hat) AS residual FROM preds JOIN")


def conformal_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    scored = scored_naive(t)
    residuals = conformal.calibration_residuals(scored.where("split <> 'test'"))
    q = conformal.conformal_quantile(residuals, 0.1, by=["model_id"])
    return q, conformal.prediction_intervals(scored.where("split = 'test'"), q, by=["model_id"])


@query("conformal_q", BASE + CONFORMAL + " SELECT model_id, n, round(q, 5) AS q FROM q")
def conformal_q(t: Tables):
    return conformal_parts(t)[0].select("model_id", "n", r6("q", digits=5))


@query("conformal_interval", BASE + CONFORMAL + " SELECT ds, model_id, round(lower, 5) AS lower, round(upper, 5) AS upper FROM bands")
def conformal_interval(t: Tables):
    return conformal_parts(t)[1].select("ds", "model_id", r6("lower", digits=5), r6("upper", digits=5))


@query(
    "coverage",
    BASE + CONFORMAL + """ SELECT model_id, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM bands GROUP BY model_id""",
)
def coverage(t: Tables):
    return conformal.empirical_coverage(conformal_parts(t)[1], by=["model_id"]).select("model_id", r6("coverage"))


# --- drift ---------------------------------------------------------------------------------------

DRIFT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def ks_sql(cols: list[str], source: str, flag: str) -> str:
    """Common table expressions that end in ``ks(feature, n_ref, n_cur, d)``."""
    vals = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {flag} AS r FROM {source}" for c in cols)
    return f"""vals AS ({vals}), cnt AS (SELECT feature, v, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE NOT r) AS b FROM vals GROUP BY 1, 2),
    cum AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v) / sum(a) OVER (PARTITION BY feature) AS fa,
      sum(b) OVER (PARTITION BY feature ORDER BY v) / sum(b) OVER (PARTITION BY feature) AS fb,
      CAST(sum(a) OVER (PARTITION BY feature) AS BIGINT) AS n_ref, CAST(sum(b) OVER (PARTITION BY feature) AS BIGINT) AS n_cur FROM cnt),
    ks AS (SELECT feature, n_ref, n_cur, max(abs(fa - fb)) AS d FROM cum GROUP BY 1, 2, 3)"""


P_SERIES = """pv AS (SELECT ks.*, CASE WHEN sqrt(n_ref * n_cur / CAST(n_ref + n_cur AS DOUBLE)) * d < 0.2 THEN 1.0 ELSE
    least(1.0, greatest(0.0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END
      * exp(-2.0 * k * k * (n_ref * n_cur / CAST(n_ref + n_cur AS DOUBLE)) * d * d)) FROM (SELECT unnest(range(1, 101)) AS k)))) END AS p_value FROM ks)"""
LINE_KS = "WITH " + ks_sql(DRIFT_COLS, "lineitem", "(l_shipdate < TIMESTAMP '1998-07-01')") + ", " + P_SERIES


def line_drift(t: Tables) -> DataFrame:
    earlier = F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    return drift.drift_report(t.lineitem, DRIFT_COLS, earlier)


@query("ks_statistic", LINE_KS + " SELECT feature, n_ref, n_cur, round(d, 6) AS d FROM ks")
def ks_statistic(t: Tables):
    return line_drift(t).select("feature", "n_ref", "n_cur", r6("d"))


@query("ks_pvalue", LINE_KS + " SELECT feature, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted FROM pv")
def ks_pvalue(t: Tables):
    return line_drift(t).select("feature", r6("p_value"), "drifted")


@query(
    "drift_summary",
    LINE_KS + """ SELECT count(*) AS columns, count(*) FILTER (WHERE p_value < 0.05) AS drifted_columns,
    count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE) AS share,
    count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE) >= 0.5 AS dataset_drift FROM pv""",
)
def drift_summary(t: Tables):
    return drift.drift_summary(line_drift(t))


@query(
    "ks_daily",
    f"""WITH {DAILY}, {SPLIT}, win AS (SELECT y, back > 30 AS ref FROM split WHERE back <= 60), """
    + ks_sql(["y"], "win", "ref")
    + """, h AS (SELECT *, CAST(round(d * n_ref) AS BIGINT) AS h FROM ks),
    terms AS (SELECT j, (SELECT product((n_ref - j * h + i) / CAST(n_ref + i AS DOUBLE)) FROM (SELECT unnest(range(1, CAST(j * h + 1 AS BIGINT))) AS i)) AS p
      FROM h, (SELECT unnest(range(1, 31)) AS j) WHERE j * h <= n_ref)
    SELECT feature, n_ref, n_cur, round(d, 6) AS d,
      round(least(1.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN p ELSE -p END) FROM terms)), 6) AS p_value FROM h""",
)
def ks_daily(t: Tables):
    windows = ops.adjacent_windows(orders_daily(t), 30)
    report = drift.drift_report(windows, ["y"], F.col("part") == "reference", method="exact")
    return report.select("feature", "n_ref", "n_cur", r6("d"), r6("p_value"))
