"""Profiles of a table: counts, nulls, descriptions, correlations, histograms, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsflow.functions.scalar import clip, number
from obsflow.operators.quantiles import quantiles
from obsflow.operators.slices import SLICE, in_slices, join_edges, numbered, per_slice, slices_before
from obsflow.session import broadcast_if_small


def split_feature_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """``(categorical, numerical)`` column names; booleans and times are in neither list."""
    categorical = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    numerical = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return categorical, numerical


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Columns whose name contains ``part``, ignoring case."""
    return [c for c in df.columns if part.lower() in c.lower()]


def preferred_columns(df: DataFrame, preferred: Sequence[str], *, at_least: int = 4, fallback: int = 12) -> list[str]:
    """The preferred numeric columns that exist; the first ``fallback`` numeric ones if too few do."""
    _, numerical = split_feature_types(df)
    found = [c for c in preferred if c in numerical]
    return found if len(found) >= at_least else numerical[:fallback]


def unpivoted(row: DataFrame, values: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per outer key out of a one-row aggregate: ``(feature, <inner keys>)``."""
    items = [
        F.struct(F.lit(name).alias("feature"), *[c.alias(k) for k, c in parts.items()])
        for name, parts in values.items()
    ]
    return row.select(F.inline(F.array(*items)))


def is_missing(df: DataFrame, c: str) -> Column:
    missing = F.col(f"`{c}`").isNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(F.col(f"`{c}`"))
    return missing


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(feature, rows, nulls, null_pct)`` of all columns in one pass."""
    cols = list(cols or df.columns)
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]
    )
    share = lambda i: F.col(f"n{i}") / F.col("rows") * 100
    return unpivoted(
        counts,
        {c: {"rows": F.col("rows"), "nulls": F.col(f"n{i}"), "null_pct": share(i)} for i, c in enumerate(cols)},
    )


def value_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, freq)`` including nulls."""
    fields = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*fields))).groupBy("feature", "value").agg(F.count("*").alias("freq"))


def value_counts(df: DataFrame, col: str, top: int = 10) -> DataFrame:
    """The ``top`` most frequent values, nulls included; ties by value, null last."""
    counted = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, freq)``: most frequent known value per column, smallest on ties."""
    ranked = F.struct(-F.col("freq"), F.col("value"))
    return (
        value_frequencies(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("feature")
        .agg(F.min_by("value", ranked).alias("value"), F.max("freq").alias("freq"))
    )


def describe_numeric(df: DataFrame, cols: Sequence[str], *, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        v = number(F.col(f"`{c}`"))
        aggs += [
            F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
    moments = unpivoted(
        df.agg(*aggs), {c: {k: F.col(f"{k}{i}") for k in ("mean", "std", "min", "max")} for i, c in enumerate(cols)}
    )
    quarts = quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    return moments.join(quarts.withColumnRenamed("n", "count"), "feature", "left").fillna(0, ["count"])


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, distinct count, most frequent value and its frequency per column."""
    ranked = F.struct(-F.col("freq"), F.col("value"))
    return (
        value_frequencies(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("feature")
        .agg(
            F.sum("freq").alias("count"),
            F.count("*").alias("unique"),
            F.min_by("value", ranked).alias("top"),
            F.max("freq").alias("freq"),
        )
    )


def nunique(df: DataFrame, cols: Sequence[str], *, exact: bool = True) -> DataFrame:
    """``(feature, nunique)`` without nulls; ``exact=False`` uses one pass of sketches."""
    if exact:
        return (
            value_frequencies(df, cols)
            .groupBy("feature")
            .agg(F.count("value").alias("nunique"))
        )
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"u{i}") for i, c in enumerate(cols)])
    return unpivoted(row, {c: {"nunique": F.col(f"u{i}")} for i, c in enumerate(cols)})


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, min, max)`` of numeric columns."""
    row = df.agg(*[f(number(F.col(f"`{c}`"))).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("min", F.min), ("max", F.max))])
    return unpivoted(row, {c: {"min": F.col(f"min{i}"), "max": F.col(f"max{i}")} for i, c in enumerate(cols)})


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every column known."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & ~is_missing(df, c)
    return df.where(keep)


def kept_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(rows, kept, kept_pct)`` of the complete-case filter."""
    known = ~F.greatest(*[is_missing(df, c) for c in cols]) if len(cols) > 1 else ~is_missing(df, cols[0])
    return df.agg(F.count("*").alias("rows"), F.count_if(known).alias("kept")).withColumn(
        "kept_pct", F.col("kept") / F.col("rows") * 100
    )


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(x, y, r)``: Pearson correlation of each pair in one pass, nulls dropped pairwise."""
    row = df.agg(*[F.corr(number(F.col(f"`{a}`")), number(F.col(f"`{b}`"))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*items)))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full square in long form; one pass computes one triangle and the diagonal."""
    half = correlations(df, list(combinations_with_replacement(cols, 2)))
    swapped = F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y", "r"))).otherwise(
        F.array(F.struct("x", "y", "r"), swapped)
    )
    return half.select(F.inline(both))


def correlation_block(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Rectangular block on the complete cases of all columns."""
    return correlations(complete_cases(df, [*xs, *ys]), list(product(xs, ys)))


def top_correlations(block: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pairs with the largest absolute correlation."""
    return block.orderBy(F.desc(F.abs("r")), "x", "y").limit(n)


def group_stats(df: DataFrame, group: str, value: str, *, min_count: int = 100) -> DataFrame:
    """Mean, sample deviation and count of groups with enough known values."""
    v = number(value)
    return (
        df.groupBy(group)
        .agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count"))
        .where(F.col("count") >= min_count)
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``(bin, lower, upper, n)`` of equal bins between minimum and maximum; the maximum is in the last."""
    v = number(col)
    span = df.select(v.alias("v")).agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, width = span["lo"], (span["hi"] - span["lo"]) / bins
    rows = df.select(v.alias("v"), lo.alias("lo"), width.alias("width")).where(F.col("v").isNotNull())
    position = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("width"), F.lit(0.0)))
    counted = (
        rows.groupBy(F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "lo", "width")
        .agg(F.count("*").alias("n"))
    )
    return counted.select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        "n",
    )


def box_stats(df: DataFrame, group: str, value: str, *, cap: float = 0.99, multiplier: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and fliers per group after capping at a global upper quantile.

    Groups are ordered by falling median in ``place``.
    """
    known = df.select(F.col(group), number(value).alias("v")).where(F.col("v").isNotNull())
    top = quantiles(known, ["v"], {"cap": cap}).first()
    capped = known.withColumn("v", clip("v", upper=top["cap"] if top else None))
    quarts = quantiles(capped, ["v"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[group]).drop("feature")
    quarts = broadcast_if_small(quarts)
    reach = (F.col("q3") - F.col("q1")) * multiplier
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col("v").between(low, high)
    boxes = (
        capped.join(quarts, group)
        .groupBy(group, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("fliers"),
        )
    )
    order = [F.desc("median"), group]
    return numbered(in_slices(boxes, order), [], order, "place").drop(SLICE)


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``(feature, outliers)`` outside given fences, all columns in one pass."""
    cols = list(bounds)
    row = df.agg(
        *[F.count_if((F.col(f"`{c}`") < lo) | (F.col(f"`{c}`") > hi)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())]
    )
    return unpivoted(row, {c: {"outliers": F.col(f"o{i}")} for i, c in enumerate(cols)})


def average_rank(col: str, *, by: Sequence[str] = ()) -> Column:
    """Falling average rank, truncated to an integer."""
    ordered = W.partitionBy(*by).orderBy(F.desc(col))
    ties = F.count("*").over(W.partitionBy(*by, col))
    return F.floor(F.rank().over(ordered) + (ties - 1) / 2).cast("long")


def average_ranks(df: DataFrame, col: str, *, name: str = "avg_rank") -> DataFrame:
    """``df`` with the falling average rank of a whole column, without one global sort task.

    The ranks are worked out on the counted distinct values and joined back. Their prefix sums go over range slices, each shifted by the
    rows of the slices above. Rows without a value are kept and have no rank.
    """
    falling = F.desc(col)
    counted = in_slices(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("ties")), [falling])
    totals = counted.groupBy(SLICE).agg(F.sum("ties").alias("total"))
    shift = totals.select(SLICE, F.coalesce(F.sum("total").over(slices_before([])), F.lit(0)).alias("shift"))
    inner = F.sum("ties").over(per_slice([], [falling]).rowsBetween(W.unboundedPreceding, -1))
    above = join_edges(counted.withColumn("inner", F.coalesce(inner, F.lit(0))), shift, [])
    rank = F.floor(F.col("inner") + F.col("shift") + (F.col("ties") + 1) / 2).cast("long")
    return df.join(broadcast_if_small(above.select(col, rank.alias(name))), col, "left").select(*df.columns, name)
