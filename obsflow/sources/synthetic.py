"""A deterministic smooth series for tests and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mean, yearly swing and ripple of the series.
LEVEL, SWING, RIPPLE = 16.03, 6.0, 0.6


def series_value(i: Column) -> Column:
    """Value of day number ``i``."""
    return LEVEL + SWING * F.sin(2 * math.pi * i / 365.0) + RIPPLE * F.sin(i / 3.0)


def synthetic_series(spark: SparkSession, days: int, *, start: str = "2024-01-01", digits: int = 2) -> DataFrame:
    """``(key, ds, y)`` of the first ``days`` days."""
    return spark.range(days).select(
        F.lit("global").alias("key"),
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("ds"),
        F.bround(series_value(F.col("id")), digits).alias("y"),
    )
