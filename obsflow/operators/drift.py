"""Two-sample Kolmogorov-Smirnov drift test for many columns.

Rows are counted per distinct value first, and the counted values are cut into range slices. The distance of the two distribution functions at the
ends of a slice is known from the totals of the slices, and so is how far it can get inside one. Only slices that can still hold the largest
distance are looked at value by value (branch and bound), each in a window of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.functions.scalar import number
from obsflow.operators.slices import SLICE, in_slices, join_edges, per_slice, slices_before
from obsflow.session import spread

# Fixed thresholds of the verdicts.
P_THRESHOLD = 0.05
DRIFT_SHARE = 0.5


def _slice_bounds(counted: DataFrame) -> DataFrame:
    """``(_slice, feature, n_ref, n_cur, s_ref, s_cur, at_end, bound)``.

    ``s_`` are the rows in front of a slice, ``at_end`` is the distance behind its last value, and no distance inside is above ``bound``.
    """
    totals = counted.groupBy(SLICE, "feature").agg(F.sum("c_ref").alias("t_ref"), F.sum("c_cur").alias("t_cur"))
    whole, before = W.partitionBy("feature"), slices_before(["feature"])
    sums = totals.select(
        SLICE, "feature", "t_ref", "t_cur",
        F.sum("t_ref").over(whole).alias("n_ref"), F.sum("t_cur").over(whole).alias("n_cur"),
        F.coalesce(F.sum("t_ref").over(before), F.lit(0)).alias("s_ref"),
        F.coalesce(F.sum("t_cur").over(before), F.lit(0)).alias("s_cur"),
    )
    # A column without rows on one side has no distribution function there, and no distance.
    n_ref, n_cur = F.nullif("n_ref", F.lit(0)), F.nullif("n_cur", F.lit(0))
    ref_lo, cur_lo = F.col("s_ref") / n_ref, F.col("s_cur") / n_cur
    ref_hi, cur_hi = (F.col("s_ref") + F.col("t_ref")) / n_ref, (F.col("s_cur") + F.col("t_cur")) / n_cur
    return sums.select(
        SLICE, "feature", "n_ref", "n_cur", "s_ref", "s_cur",
        F.abs(ref_hi - cur_hi).alias("at_end"), F.greatest(ref_hi - cur_lo, cur_hi - ref_lo).alias("bound"),
    )


def open_slices(counted: DataFrame) -> DataFrame:
    """The bounds of all slices, with ``best``, the largest distance at their ends, and whether a slice is ``open``: it can hold a larger one."""
    bounds = _slice_bounds(counted)
    best = F.max("at_end").over(W.partitionBy("feature"))
    return bounds.withColumn("best", best).withColumn("open", F.coalesce(F.col("bound") > F.col("best"), F.lit(False)))


def counted_values(df: DataFrame, cols: Sequence[str], is_reference: Column, slices: int | None = None) -> DataFrame:
    """``(feature, value, c_ref, c_cur)`` of every distinct value, in slices."""
    df = spread(df.select(is_reference.alias("r"), *[f"`{c}`" for c in cols]))
    items = [F.struct(F.lit(c).alias("feature"), number(F.col(f"`{c}`")).alias("value")) for c in cols]
    counted = (
        df.select("r", F.inline(F.array(*items)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if(F.col("r")).alias("c_ref"), F.count_if(~F.col("r")).alias("c_cur"))
    )
    return in_slices(counted, ["feature", "value"], slices)


def ks_statistics(df: DataFrame, cols: Sequence[str], is_reference: Column, *, slices: int | None = None) -> DataFrame:
    """``(feature, n_ref, n_cur, d)``: largest distance of the two distribution functions."""
    counted = counted_values(df, cols, is_reference, slices)
    ends = open_slices(counted)
    running = per_slice(["feature"], ["value"]).rowsBetween(W.unboundedPreceding, 0)
    looked = join_edges(counted, ends, ["feature"]).where("open")
    steps = looked.withColumns({"u_ref": F.sum("c_ref").over(running), "u_cur": F.sum("c_cur").over(running)})
    f_ref, f_cur = (F.col("s_ref") + F.col("u_ref")) / F.col("n_ref"), (F.col("s_cur") + F.col("u_cur")) / F.col("n_cur")
    inside = steps.groupBy("feature").agg(F.max(F.abs(f_ref - f_cur)).alias("_inside"))
    outside = ends.groupBy("feature", "n_ref", "n_cur").agg(F.max("at_end").alias("_end"))
    return outside.join(inside, "feature", "left").select("feature", "n_ref", "n_cur", F.greatest("_end", "_inside").alias("d"))


def ks_p_value(d: Column, n: Column, m: Column, *, method: str = "series") -> Column:
    """Two-sided p-value by the Kolmogorov series, or by the ``exact`` path count, which is for samples of equal size.

    The exact count of one column has as many terms as a sample has rows.
    """
    if method not in ("series", "exact"):
        raise ValueError(f"unknown method {method!r}, known are 'series' and 'exact'")
    h = F.round(d * n)
    steps = F.when(h > 0, F.floor(n / h)).otherwise(0).cast("int")

    def path_share(j: Column) -> Column:
        reach = (j * h).cast("int")
        ratios = F.transform(F.sequence(F.lit(1), reach), lambda i: (n - reach + i) / (n + i))
        product = F.aggregate(ratios, F.lit(1.0), lambda acc, x: acc * x)
        return F.when(j % 2 == 1, product).otherwise(-product)

    shares = F.transform(F.sequence(F.lit(1), steps), path_share)
    exact = F.when(h <= 0, 1.0).otherwise(2 * F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x))

    root = F.sqrt(n * m / (n + m)) * d
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * root * root),
    )
    # The alternating series only settles away from zero; below this point p is 1 to 15 digits.
    series = F.when(root < 0.2, 1.0).otherwise(2 * F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    unequal = F.raise_error(F.format_string("the exact p-value is for samples of equal size, not %s and %s", n, m))
    p = F.when(n == m, exact).otherwise(unequal.cast("double")) if method == "exact" else series
    return F.when(d.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def drift_report(
    df: DataFrame, cols: Sequence[str], is_reference: Column, *, p_threshold: float = P_THRESHOLD,
    method: str = "series", slices: int | None = None,
) -> DataFrame:
    """``(feature, n_ref, n_cur, d, p_value, drifted)``; ``method`` is that of :func:`ks_p_value`."""
    stats = ks_statistics(df, cols, is_reference, slices=slices)
    p = ks_p_value(F.col("d"), F.col("n_ref"), F.col("n_cur"), method=method)
    return stats.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < p_threshold)


def drift_summary(report: DataFrame, *, drift_share: float = DRIFT_SHARE) -> DataFrame:
    """``(columns, drifted_columns, share, dataset_drift)``; an empty report is an error, never zero drift."""
    counts = report.agg(
        F.count("*").alias("columns"), F.count_if(F.col("drifted")).alias("drifted_columns")
    )
    guard = F.assert_true(F.col("columns") > 0, F.lit("the drift report has no tested column"))
    return (
        counts.where(guard.isNull())
        .withColumn("share", F.col("drifted_columns") / F.col("columns"))
        .withColumn("dataset_drift", F.col("share") >= drift_share)
    )
