"""Split-conformal intervals per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.operators.quantiles import order_statistics
from obsflow.session import broadcast_if_small


def calibration_residuals(scored: DataFrame) -> DataFrame:
    """Adds ``residual``: absolute error of ``(y, y_hat)`` rows."""
    return scored.withColumn("residual", F.abs(F.col("y") - F.col("y_hat")))


def conformal_quantile(residuals: DataFrame, alpha: float, *, by: Sequence[str] = ("key",)) -> DataFrame:
    """``(by..., n, q)``: the order statistic of rank ``ceil((n + 1)(1 - alpha))``, kept within 1..n.

    A key with no known residual has no row; a table without any is an error when it is used.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must be in (0, 1), got {alpha!r}")

    def rank(n):
        return F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * F.lit(1 - alpha)))) - 1

    found = order_statistics(residuals, ["residual"], {"q": rank}, by=by)  # stored, so looking at it is no second run
    if found.isEmpty():
        raise ValueError("residuals must not be empty")
    return found.select(*by, "n", F.col("value").alias("q"))


def prediction_intervals(predictions: DataFrame, q: DataFrame, *, by: Sequence[str] = ("key",)) -> DataFrame:
    """Adds ``lower`` and ``upper`` around ``y_hat``."""
    widths = broadcast_if_small(q.select(*by, "q"))
    joined = predictions.join(widths, list(by))
    return joined.withColumns({"lower": F.col("y_hat") - F.col("q"), "upper": F.col("y_hat") + F.col("q")}).drop("q")


def empirical_coverage(intervals: DataFrame, *, by: Sequence[str] = ("key",)) -> DataFrame:
    """Share of true values within their closed interval."""
    inside = F.col("y").between(F.col("lower"), F.col("upper"))
    return intervals.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"))
