"""Scores of predictions, ensembles over models, and the alignment guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed names of the two ensembles.
SIMPLE, WEIGHTED = "ensemble_simple", "ensemble_weighted"


def compute_metrics(scored: DataFrame, by: Sequence[str] = ("key", "model_id")) -> DataFrame:
    """RMSE, MAE and MAPE of ``(y, y_hat)`` rows per group; zero truth is left out of MAPE only."""
    error = F.col("y") - F.col("y_hat")
    relative = F.when(F.col("y") != 0, F.abs(error / F.col("y")))
    return scored.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse_c"),
        F.avg(F.abs(error)).alias("mae_c"),
        (F.avg(relative) * 100).alias("mape_pct"),
    )


def with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions joined with the true values on ``(key, ds)``."""
    return predictions.join(truth.select("key", "ds", "y"), ["key", "ds"])


def alignment(a: DataFrame, b: DataFrame, on: Sequence[str] = ("key", "ds")) -> DataFrame:
    """Guard row: sizes, rows without a partner on each side, and whether all rows are matched."""
    left = a.select(*on, F.lit(1).alias("in_a"))
    right = b.select(*on, F.lit(1).alias("in_b"))
    both = left.join(right, list(on), "full")
    return both.agg(
        F.count("in_a").alias("rows_a"),
        F.count("in_b").alias("rows_b"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
    ).withColumn("aligned", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def inverse_rmse_weights(metrics: DataFrame) -> DataFrame:
    """``(key, model_id, weight)``: inverse validation RMSE, normalised within a key."""
    inverse = 1.0 / F.col("rmse_c")
    total = F.sum(inverse).over(W.partitionBy("key"))
    return metrics.select("key", "model_id", (inverse / total).alias("weight"))


def weighted_ensemble(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the models of a row; a model without a prediction leaves its weight to the others."""
    known = F.col("y_hat").isNotNull()
    return (
        predictions.join(weights, ["key", "model_id"])
        .groupBy("key", "ds")
        .agg(F.sum(F.when(known, F.col("weight") * F.col("y_hat"))).alias("y_hat"), F.sum(F.when(known, F.col("weight"))).alias("_whole"))
        .select("key", "ds", (F.col("y_hat") / F.nullif("_whole", F.lit(0.0))).alias("y_hat"), F.lit(WEIGHTED).alias("model_id"))
    )


def simple_average(predictions: DataFrame) -> DataFrame:
    """Mean over the models of a row."""
    return (
        predictions.groupBy("key", "ds")
        .agg(F.avg("y_hat").alias("y_hat"))
        .withColumn("model_id", F.lit(SIMPLE))
    )


def leaderboard(metrics: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Metric rows of all models, those of an outside baseline appended, best first."""
    rows = metrics if extra is None else metrics.unionByName(extra, allowMissingColumns=True)
    return rows.withColumn(
        "place", F.row_number().over(W.partitionBy("key").orderBy("rmse_c", "model_id"))
    ).orderBy("key", "place")


def best_model(metrics: DataFrame) -> DataFrame:
    """Per key the final row with the smallest RMSE (first id on ties) and the largest RMSE for scaling."""
    final = metrics.where(F.col("rmse_c").isNotNull() & (F.col("status") == "final"))
    return final.groupBy("key").agg(
        F.min_by("model_id", F.struct("rmse_c", "model_id")).alias("best_id"),
        F.min("rmse_c").alias("best_rmse"),
        F.max("rmse_c").alias("max_rmse"),
    )


def flattened_metrics(metrics: DataFrame) -> DataFrame:
    """``(key, metric, value)`` with metric names ``<model>.<measure>``."""
    long = metrics.unpivot(["key", "model_id"], ["rmse_c", "mae_c", "mape_pct"], "measure", "value")
    return long.select("key", F.concat_ws(".", "model_id", "measure").alias("metric"), "value")
