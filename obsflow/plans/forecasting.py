"""Forecasts, stationarity, importances and Shapley values on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.operators import anomaly, evaluate, explain, forecast
from obsflow.operators import series as ops
from obsflow.plans.catalog import Tables, query, r6
from obsflow.plans.forecast_run import run_forecast
from obsflow.plans.series import DAILY, orders_daily
from obsflow.session import checkpointed, spread

TARGET = "l_extendedprice"
DRIVERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


def thousands(t: Tables) -> DataFrame:
    """The daily series in thousands, which keeps sums of squares in a comparable range."""
    return orders_daily(t).withColumn("y", F.col("y") / 1000)


def type_panel(t: Tables) -> DataFrame:
    """One daily series per event type."""
    return ops.daily_mean(t.events, "ts", "value", key="event_type")


GRAM = [(a, b) for a in range(1, 6) for b in range(a, 6)]


@query(
    "ar_gram",
    f"""WITH {DAILY}, d AS (SELECT ds, (y - lag(y) OVER (ORDER BY ds)) / 1000 AS w FROM daily),
    x AS (SELECT ds, w, """
    + ", ".join(f"lag(w, {k}) OVER (ORDER BY ds) AS w{k}" for k in range(1, 6))
    + " FROM d) SELECT count(*) AS n, "
    + ", ".join(f"round(sum(w{a} * w{b}), 2) AS xx_{a}{b}" for a, b in GRAM)
    + ", "
    + ", ".join(f"round(sum(w{k} * w), 2) AS xy_{k}" for k in range(1, 6))
    + " FROM x WHERE w5 IS NOT NULL",
)
def ar_gram(t: Tables):
    row = forecast.ar_gram(thousands(t))
    xx = [r6(F.col("xx")[i], f"xx_{a}{b}", 2) for i, (a, b) in enumerate(GRAM)]
    return row.select("n", *xx, *[r6(F.col("xy")[k - 1], f"xy_{k}", 2) for k in range(1, 6)])


def holdout(t: Tables) -> tuple[DataFrame, DataFrame]:
    split = ops.split_tail(orders_daily(t), test=30)
    return split.where("split = 'train'"), split.where("split = 'test'")


@query("ar_forecast")
def ar_forecast(t: Tables):
    train, test = holdout(t)
    return forecast.on_dates(forecast.arima_forecast(train, 30), test, "arima")


@query("sar_forecast")
def sar_forecast(t: Tables):
    train, test = holdout(t)
    return forecast.on_dates(forecast.sarima_forecast(train, 30), test, "sarima")


@query("ar_panel")
def ar_panel(t: Tables):
    return forecast.arima_forecast(type_panel(t), 7)


@query(
    "seasonal_naive",
    """
    WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, avg(value) AS y FROM events GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS back FROM d)
    SELECT key, CAST(h.step AS INTEGER) AS step, round(y, 6) AS y_hat FROM b JOIN (SELECT unnest(range(1, 31)) AS step) h
      ON 8 - back = (h.step - 1) % 7 + 1 WHERE back <= 7
    """,
)
def seasonal_naive(t: Tables):
    return forecast.seasonal_naive(type_panel(t), 30).select("key", "step", r6("y_hat"))


@query(
    "future_frame",
    f"""WITH {DAILY} SELECT ds, FALSE AS is_future FROM daily
    UNION ALL SELECT CAST(last + CAST(i AS INTEGER) AS DATE), TRUE FROM (SELECT max(ds) AS last FROM daily), (SELECT unnest(range(1, 31)) AS i)""",
)
def future_frame(t: Tables):
    return forecast.future_frame(orders_daily(t), 30).select("ds", "is_future")


@query("trend_fourier")
def trend_fourier(t: Tables):
    series = orders_daily(t)
    split = ops.split_cutoff(series, days=30)
    frame = forecast.future_frame(series, 30)
    return forecast.trend_fourier(split.where("split = 'train'"), frame)


@query("pacf")
def pacf(t: Tables):
    return forecast.partial_autocorrelation(ops.autocorrelation(orders_daily(t), 40))


@query("adf_stat")
def adf_stat(t: Tables):
    return forecast.adf_test(orders_daily(t))


def boosted_rows(t: Tables) -> DataFrame:
    series = orders_daily(t)
    split = ops.split_tail(series, test=30, val=30)
    features = ops.create_features(series).join(split.select("key", "ds", "split"), ["key", "ds"])
    rows = forecast.assembled(features, ops.feature_names())
    return checkpointed(rows.select("key", "ds", "y", "split", "features", "label"))


@query("gbt_forecast")
def gbt_forecast(t: Tables):
    rows = boosted_rows(t)
    model = forecast.train_gradient_boosting(rows.where("split <> 'test'"))
    return forecast.model_predictions(model, rows.where("split = 'test'"), "gradientboosting")


@query("gbt_early_stop")
def gbt_early_stop(t: Tables):
    rows = boosted_rows(t)
    model, kept = forecast.train_early_stopped(rows.where("split = 'train'"), rows.where("split = 'val'"))
    test = forecast.model_predictions(model, rows.where("split = 'test'"), "lightgbm")
    return test.withColumn("rounds", F.lit(kept))


@query("run_forecast")
def forecast_run(t: Tables):
    return run_forecast(orders_daily(t))["metrics"]


# --- importances ---------------------------------------------------------------------------------


def driver_rows(t: Tables) -> DataFrame:
    table = t.lineitem.select("l_orderkey", "l_partkey", *DRIVERS, TARGET)
    rows = anomaly.hash_split(explain.feature_rows(spread(table), DRIVERS, TARGET), F.col("l_orderkey"))
    return rows if explain.many_rows(rows) else rows.persist()  # many rows are read a few times only, and would push the trees' points to disk


def boosted_drivers(rows: DataFrame):
    """Early-stopped boosting on the training part only; a fifth of its keys is the validation part.

    Many rows are boosted as cells, so that all rounds after the first pass work on bins; the validation part stays as rows.
    """
    inner = anomaly.hash_split(rows.where("part = 'train'").drop("part"), F.col("l_orderkey"), salt=7)
    train, val = inner.where("part = 'train'"), inner.where("part = 'test'")
    params = {"patience": 5, "maxIter": 20, "stepSize": 0.2}
    if not explain.many_rows(train):
        return forecast.train_early_stopped(train, val, **params)[0]
    grouped = checkpointed(explain.cells(train, DRIVERS))
    return forecast.train_early_stopped(grouped, val.select("features", "label", F.lit(1.0).alias("weight")), weightCol="weight", **params)[0]


@query("rf_importance")
def rf_importance(t: Tables):
    rows = driver_rows(t)
    train = rows.where("part = 'train'")
    model = explain.cell_forest(train, DRIVERS) if explain.many_rows(train) else explain.random_forest(train)
    rows.unpersist()
    return explain.importances(rows, model, DRIVERS, "importance")


@query("gbt_importance")
def gbt_importance(t: Tables):
    rows = driver_rows(t)
    model = boosted_drivers(rows)
    rows.unpersist()
    return explain.importances(rows, model, DRIVERS, "importance")


def explained_sample(t: Tables) -> DataFrame:
    """Shapley values of 1,000 rows the model has not seen."""
    rows = driver_rows(t)
    model = boosted_drivers(rows)
    row_hash = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sample = checkpointed(anomaly.hash_sample(rows.where("part = 'test'"), 1000, row_hash))
    rows.unpersist()
    shap, _ = explain.tree_shap(sample, model, DRIVERS, id_cols=["l_orderkey", "l_linenumber", "l_partkey"])
    return explain.value_norms(shap)


@query("tree_shap")
def tree_shap(t: Tables):
    return explained_sample(t)


RANKED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "importance_compare",
    "WITH i AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS a, CAST(count(DISTINCT {c}) AS DOUBLE) AS b, avg(abs({c})) AS c FROM lineitem" for c in RANKED
    )
    + "), s AS (SELECT "
    + ", ".join(f"min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in "abc")
    + " FROM i), n AS (SELECT feature, "
    + ", ".join(f"({m} - lo_{m}) / (hi_{m} - lo_{m}) AS {m}_norm" for m in "abc")
    + ", "
    + ", ".join(f"CAST(rank() OVER (ORDER BY {m} DESC) AS BIGINT) AS {m}_rank" for m in "abc")
    + " FROM i, s) SELECT feature, "
    + ", ".join(f"round({m}_norm, 6) AS {m}_norm, {m}_rank" for m in "abc")
    + ", round((a_norm + b_norm + c_norm) / 3, 6) AS avg_norm FROM n",
)
def importance_compare(t: Tables):
    from obsflow.operators import profile

    line = t.lineitem
    a = profile.correlations(line, [(c, TARGET) for c in RANKED]).select(F.col("x").alias("feature"), F.abs("r").alias("a"))
    b = profile.nunique(line, RANKED).select("feature", F.col("nunique").cast("double").alias("b"))
    means = line.agg(*[F.avg(F.abs(c)).alias(c) for c in RANKED])
    c = profile.unpivoted(means, {x: {"c": F.col(x)} for x in RANKED})
    compared = explain.compare_importances(a, b, c)
    norms = [r6(f"{m}_norm") for m in "abc"]
    return compared.select("feature", *norms, *[f"{m}_rank" for m in "abc"], r6("avg_norm"))
