"""Keyed daily series: building them, their features, and ordered operators on raw rows.

A series holds one row per key and day, so a window per key is bounded by the calendar. Raw rows are
not: there, ordered operators work in range slices of counted rows and carry the edges of the slices over, so a
key or a day that holds most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.functions.scalar import as_column, calendar_fields, cyclical_fields, day_of, number
from obsflow.operators.slices import SLICE, in_slices, join_edges, per_slice, side_by_side, slices_after, slices_before

# Fixed default values of the feature set.
DEFAULT_LAGS = (1, 2, 3, 7, 14, 21)
DEFAULT_ROLLING_WINDOWS = (7, 14, 30)
GLOBAL_KEY = "global"


def daily_mean(df: DataFrame, ts: str, value: str | Column, *, key: Column | str | None = None) -> DataFrame:
    """``(key, ds, y)``: mean of the known values of every calendar day."""
    key_col = F.lit(GLOBAL_KEY) if key is None else as_column(key)
    return (
        df.select(key_col.alias("key"), day_of(ts).alias("ds"), number(value).alias("y"))
        .where(F.col("ds").isNotNull())
        .groupBy("key", "ds")
        .agg(F.avg("y").alias("y"))
    )


def per_key() -> W:
    return W.partitionBy("key").orderBy("ds")


def lag_columns(lags: Sequence[int]) -> dict[str, Column]:
    """Positional lags: ``lag_7`` is seven rows ago, whatever the dates are."""
    return {f"lag_{k}": F.lag("y", k).over(per_key()) for k in lags}


def rolling_columns(windows: Sequence[int]) -> dict[str, Column]:
    """Mean and sample deviation of the ``w`` rows before this one, only when all ``w`` are known."""
    out: dict[str, Column] = {}
    for w in windows:
        before = per_key().rowsBetween(-w, -1)
        full = F.count("y").over(before) == w
        out[f"rolling_mean_{w}"] = F.when(full, F.avg("y").over(before))
        out[f"rolling_std_{w}"] = F.when(full, F.stddev_samp("y").over(before))
    return out


def create_features(
    series: DataFrame,
    *,
    lags: Sequence[int] = DEFAULT_LAGS,
    rolling_windows: Sequence[int] = DEFAULT_ROLLING_WINDOWS,
) -> DataFrame:
    """Lag, rolling, calendar and cyclical columns; one sort per key serves them all.

    No feature of a row looks at its own ``y`` or a later one. The first rows of a key keep NULLs.
    """
    windowed = {**lag_columns(lags), **rolling_columns(rolling_windows)}
    return series.select(
        "key", "ds", "y",
        *[c.alias(n) for n, c in windowed.items()],
        *[c.alias(n) for n, c in calendar_fields("ds").items()],
        *[c.alias(n) for n, c in cyclical_fields("ds").items()],
    )


def feature_names(
    lags: Sequence[int] = DEFAULT_LAGS, rolling_windows: Sequence[int] = DEFAULT_ROLLING_WINDOWS
) -> list[str]:
    rolling = [f"rolling_{s}_{w}" for w in rolling_windows for s in ("mean", "std")]
    return [f"lag_{k}" for k in lags] + rolling + [*calendar_fields("ds"), *cyclical_fields("ds")]


def split_tail(series: DataFrame, *, test: int, val: int = 0, short: str = "error") -> DataFrame:
    """Positional holdout: the last ``test`` rows of a key, before them ``val`` rows, the rest is train.

    Sizes must leave at least one training row in every key. A key that is too short is an error when the plan runs; with ``short="train"`` all its
    rows are training rows instead, so that one such key among many doesn't stop the others.
    """
    if test < 0 or val < 0 or test + val < 1:
        raise ValueError(f"holdout sizes must be positive, got test={test} and val={val}")
    if short not in ("error", "train"):
        raise ValueError(f"short must be 'error' or 'train', got {short!r}")
    back = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ds")))
    size = F.count("*").over(W.partitionBy("key"))
    label = F.when(F.col("back") <= test, "test").when(F.col("back") <= test + val, "val").otherwise("train")
    rows = series.withColumns({"back": back, "size": size})
    enough = F.col("size") > test + val
    if short == "error":
        guard = F.assert_true(enough, F.format_string(f"test + val ({test} + {val}) must be < series length (%s)", F.col("size")))
        rows = rows.where(guard.isNull())
    else:
        label = F.when(enough, label).otherwise("train")
    return rows.withColumn("split", label).drop("back", "size")


def split_cutoff(series: DataFrame, *, days: int = 30) -> DataFrame:
    """Calendar holdout: rows later than ``days`` before the last day of their key are the test part."""
    last = F.max("ds").over(W.partitionBy("key"))
    return series.withColumn(
        "split", F.when(F.col("ds") > F.date_sub(last, days), "test").otherwise("train")
    )


def last_rows(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of every key."""
    back = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ds")))
    return series.withColumn("back", back).where(F.col("back") <= n).drop("back")


def adjacent_windows(series: DataFrame, w: int) -> DataFrame:
    """The last ``w`` rows as ``current`` and the ``w`` rows before as ``reference``."""
    back = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ds")))
    size = F.count("*").over(W.partitionBy("key"))
    guard = F.assert_true(
        F.col("size") >= 2 * w,
        F.format_string(f"not enough data for two {w}-row windows: only %s rows", F.col("size")),
    )
    return (
        series.withColumns({"back": back, "size": size})
        .where((F.col("back") <= 2 * w) & guard.isNull())
        .withColumn("part", F.when(F.col("back") <= w, "current").otherwise("reference"))
        .drop("back", "size")
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits per task before it shuffles."""
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", position).where(F.col("position") <= n)


def with_previous(df: DataFrame, ts: str, *, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``previous``: the time of the row before in ``(by, ts)`` order, over all rows.

    Rows are ordered inside slices; the first row of a key in a slice takes the last time of the slices before. Rows with an
    unknown key or time stay, without a previous time.
    """
    return _with_previous(in_slices(df, [*by, ts, *tie]), ts, by, tie).drop(SLICE)


def _with_previous(rows: DataFrame, ts: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    inner = F.lag(ts).over(per_slice(by, [ts, *tie]))
    edges = rows.groupBy(SLICE, *by).agg(F.max(ts).alias("_last"))
    carried = edges.select(SLICE, *by, F.max("_last").over(slices_before(by)).alias("_carried"))
    joined = join_edges(side_by_side(rows).withColumn("previous", inner), carried, by)
    previous = F.when(_all_known([*by, ts]), F.coalesce("previous", "_carried"))
    return joined.withColumn("previous", previous).drop("_carried")


def _all_known(cols: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    return known


def sessionize(df: DataFrame, ts: str, key: str, *, gap_seconds: float) -> DataFrame:
    """``(key, session_start, session_end, n)``: runs of rows with less than the gap between them.

    Rows are put together inside slices. Only the first and the last run of a key in a slice can go on in another one, so only
    these are joined across slices.
    """
    rows = df.select(key, F.col(ts).alias("first"), F.col(ts).alias("last"), F.lit(1).alias("n"))
    rows = in_slices(rows.where(F.col("first").isNotNull()), [key, "first"])
    runs = _joined_runs(rows, [key, SLICE], gap_seconds)
    last_run = F.max("run").over(W.partitionBy(key, SLICE))
    runs = runs.withColumn("_edge", (F.col("run") == 1) | (F.col("run") == last_run))
    whole = _joined_runs(runs.where("_edge"), [key], gap_seconds).drop("run")
    whole = whole.unionByName(runs.where("not _edge").select(whole.columns))
    end = (F.col("last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("session_end")
    return whole.select(key, F.col("first").alias("session_start"), end, "n")


def _joined_runs(runs: DataFrame, keys: Sequence[str], gap_seconds: float) -> DataFrame:
    """Runs ``(keys..., first, last, n)`` put together where the gap to the one before is small."""
    ordered = W.partitionBy(*keys).orderBy("first", "last")
    before = F.lag("last").over(ordered)
    starts = F.coalesce((seconds_between(F.col("first"), before) >= gap_seconds).cast("int"), F.lit(1))
    numbered = runs.withColumn("starts", starts).withColumn("run", F.sum("starts").over(ordered))
    return numbered.groupBy(*keys, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Microsecond-exact difference in seconds, for zoned and zone-free timestamps alike."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def step_counts(df: DataFrame, ts: str) -> DataFrame:
    """How often each step between successive rows occurs: ``(step_seconds, n)``; rows without a time are left out.

    Moments are counted first, so rows of one moment are one row with as many zero steps as it has further rows.
    """
    moments = in_slices(df.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.count("*").alias("_rows")), [ts])
    steps = _with_previous(moments, ts).where(F.col("previous").isNotNull())
    moved = steps.groupBy(seconds_between(F.col(ts), F.col("previous")).alias("step_seconds")).agg(F.count("*").alias("n"))
    stood = moments.agg(F.sum(F.col("_rows") - 1).alias("n")).where("n > 0").select(F.lit(0.0).alias("step_seconds"), "n")
    return moved.unionByName(stood)


def granularity(df: DataFrame, ts: str) -> DataFrame:
    """Most frequent step (smallest on ties), its count, and the number of zero steps."""
    return step_counts(df, ts).agg(
        F.min_by("step_seconds", F.struct(-F.col("n"), F.col("step_seconds"))).alias("dominant_seconds"),
        F.max("n").alias("dominant_n"),
        F.coalesce(F.sum(F.when(F.col("step_seconds") == 0, F.col("n"))), F.lit(0)).alias("same_ts"),
    )


def nearest_join(probes: DataFrame, points: DataFrame, *, ts: str, point_ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Each probe row with its nearest point in time (``nearest``); the earlier point wins a tie.

    Both sides are put together, ordered in slices of counted rows and merged: inside a slice two running windows find the point before and
    after a probe; what lies in other slices comes from their first and last points. No pair of sides is ever formed. Probes with an unknown
    key or time stay, without a point.
    """
    cols = probes.columns
    left = probes.withColumn("point", F.lit(None).cast(points.schema[point_ts].dataType)).withColumn("_probe", F.lit(True))
    distinct = points.select(*by, F.col(point_ts).alias("point")).where(F.col("point").isNotNull()).distinct().withColumn("_probe", F.lit(False))
    both = left.unionByName(distinct, allowMissingColumns=True).withColumn("_at", F.coalesce(F.col(ts), F.col("point")))
    rows = in_slices(both, [*by, "_at", "_probe"])

    ahead = per_slice(by, ["_at", "_probe"]).rowsBetween(W.unboundedPreceding, 0)
    back = per_slice(by, [F.desc("_at"), "_probe"]).rowsBetween(W.unboundedPreceding, 0)
    found = side_by_side(rows).withColumns({"before": F.last("point", True).over(ahead), "after": F.last("point", True).over(back)}).where("_probe")
    edges = rows.groupBy(SLICE, *by).agg(F.min("point").alias("first_point"), F.max("point").alias("last_point"))
    carried = edges.select(
        SLICE, *by,
        F.max("last_point").over(slices_before(by)).alias("carried_before"),
        F.min("first_point").over(slices_after(by)).alias("carried_after"),
    )
    joined = join_edges(found, carried, by)
    before, after = F.coalesce("before", "carried_before"), F.coalesce("after", "carried_after")
    closer = seconds_between(F.col(ts), before) <= seconds_between(after, F.col(ts))
    nearest = F.when(after.isNull() | closer, before).otherwise(after)
    return joined.withColumn("nearest", F.when(_all_known([*by, ts]), nearest)).select(*cols, "nearest")


def autocorrelation(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """``(key, lag, acf)`` for lags 0..max_lag with the usual biased estimator.

    A key's series becomes one array (one number per calendar day) that is multiplied with its own
    shifted slices.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ds", "y")))
    arrays = (
        series.where(F.col("y").isNotNull())
        .groupBy("key")
        .agg(F.transform(ordered, lambda s: s["y"]).alias("ys"), F.avg("y").alias("mean"))
        .select("key", F.transform("ys", lambda y: y - F.col("mean")).alias("d"))
        .select("key", "d", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    )

    def shifted(k: Column) -> Column:
        left = F.slice("d", F.lit(1), F.greatest(F.size("d") - k, F.lit(0)))
        right = F.slice("d", k + 1, F.greatest(F.size("d") - k, F.lit(0)))
        products = F.zip_with(left, right, lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    acf = shifted(F.col("lag")) / F.nullif(shifted(F.lit(0)), F.lit(0.0))
    return arrays.select("key", "lag", acf.alias("acf"))
