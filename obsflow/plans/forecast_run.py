"""The leakage-free forecast comparison over all keys of a series table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.config import Config
from obsflow.operators import evaluate, forecast
from obsflow.operators.series import create_features, feature_names, split_tail
from obsflow.session import checkpointed


def run_forecast(series: DataFrame, *, config: Config = Config(), boosting: dict | None = None) -> dict[str, DataFrame]:
    """Metrics, weights and test predictions of four models and two ensembles.

    The last ``test_window_days`` rows of a key are scored once. Early stopping and the ensemble
    weights only see the ``val_size`` rows before them: for the weights, all models but the
    early-stopped one are fitted again without those rows.
    """
    tw, vs = config.test_window_days, config.val_size
    if tw <= 0 or vs <= 0:
        raise ValueError(f"test_window_days and val_size must be positive, got {tw} and {vs}")
    boosting = boosting or {}
    split = checkpointed(split_tail(series, test=tw, val=vs))
    part = {name: split.where(F.col("split") == name) for name in ("train", "val", "test")}
    seen = split.where(F.col("split") != "test")

    cols = feature_names()
    features = create_features(split).join(split.select("key", "ds", "split"), ["key", "ds"])
    # A few thousand rows per key are trained on hundreds of times: store them once, vectors included.
    rows = checkpointed(forecast.assembled(features, cols).select("key", "ds", "y", "split", "features", "label"))
    fit_rows = {name: rows.where(F.col("split") == name) for name in ("train", "val", "test")}
    fit_seen = rows.where(F.col("split") != "test")

    # The three fits do not depend on each other: their jobs share the cluster.
    fits = [
        lambda: forecast.train_early_stopped(fit_rows["train"], fit_rows["val"], seed=config.seed, **boosting)[0],
        lambda: forecast.train_gradient_boosting(fit_seen, seed=config.seed, **boosting),
        lambda: forecast.train_gradient_boosting(fit_rows["train"], seed=config.seed, **boosting),
    ]
    with ThreadPoolExecutor(len(fits)) as pool:
        jobs = [pool.submit(inheritable_thread_target(series.sparkSession)(fit)) for fit in fits]
        stopped, boosted, boosted_val = [job.result() for job in jobs]

    predictions = _stack(
        forecast.on_dates(forecast.arima_forecast(seen, tw), part["test"], "arima"),
        forecast.on_dates(forecast.sarima_forecast(seen, tw), part["test"], "sarima"),
        forecast.model_predictions(stopped, fit_rows["test"], "lightgbm"),
        forecast.model_predictions(boosted, fit_rows["test"], "gradientboosting"),
    )
    validation = _stack(
        forecast.on_dates(forecast.arima_forecast(part["train"], vs), part["val"], "arima"),
        forecast.on_dates(forecast.sarima_forecast(part["train"], vs), part["val"], "sarima"),
        forecast.model_predictions(stopped, fit_rows["val"], "lightgbm"),
        forecast.model_predictions(boosted_val, fit_rows["val"], "gradientboosting"),
    )
    return score_run(checkpointed(predictions), checkpointed(validation), split)


def score_run(predictions: DataFrame, validation: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Weights from the validation scores, ensembles and metrics on the test predictions."""
    weights = evaluate.inverse_rmse_weights(evaluate.compute_metrics(evaluate.with_truth(validation, truth)))
    everything = _stack(
        predictions,
        evaluate.simple_average(predictions),
        evaluate.weighted_ensemble(predictions, weights),
    )
    metrics = evaluate.compute_metrics(evaluate.with_truth(everything, truth))
    metrics = metrics.join(weights.withColumnRenamed("weight", "ensemble_weight"), ["key", "model_id"], "left")
    return {
        "metrics": metrics.withColumn("status", F.lit("final")),
        "weights": weights,
        "predictions": everything,
    }


def _stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def rolling_origins(series: DataFrame, *, origins: int = 5, horizon: int = 30) -> DataFrame:
    """Rows labelled per origin: ``origin`` 0 is the last holdout, each further one lies a horizon earlier.

    ``split`` is ``test`` for the ``horizon`` rows after the origin and ``train`` for all rows before.
    """
    back = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ds")))
    numbered = series.withColumn("back", back)
    per_origin = numbered.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(origins - 1))))
    start = F.col("origin") * horizon
    return (
        per_origin.where(F.col("back") > start)
        .withColumn("split", F.when(F.col("back") <= start + horizon, "test").otherwise("train"))
        .drop("back")
    )
