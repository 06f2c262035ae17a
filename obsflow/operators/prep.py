"""Cleaning with a fit/transform split.

``fit`` works out a handful of parameters per column with distributed aggregates and keeps them on the
driver (their number is bounded by the columns and the cardinality limit); ``transform`` is one
projection with those numbers as literals, so it adds no job, join or shuffle to the plan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.functions.scalar import clip, number
from obsflow.operators import profile
from obsflow.operators.quantiles import between, medians, order_statistics, quantiles

# Fixed default: columns that are imputed and clipped but never scaled.
DEFAULT_UNSCALED = ["last_updated_epoch", "latitude", "longitude"]


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def fit_fill(df: DataFrame, num: Sequence[str], cat: Sequence[str], *, exact: bool = True) -> dict:
    """Fill values: medians of numbers, modes of texts (empty text if nothing is known)."""
    num, cat = present(df, num), present(df, cat)
    fill: dict = {}
    if num:
        fill = {r["feature"]: r["median"] for r in medians(df, num, exact=exact).collect()}
    if cat:
        found = {r["feature"]: r["value"] for r in profile.modes(df, cat).collect()}
        fill.update({c: found.get(c, "") for c in cat})
    return fill


def filled(df: DataFrame, fill: dict) -> DataFrame:
    _, numerical = profile.split_feature_types(df)

    def value(c: str) -> Column:
        v = F.col(f"`{c}`")
        if c not in fill:
            return v
        if c in numerical:
            return F.coalesce(number(v), F.lit(float(fill[c]))).alias(c)
        return F.coalesce(v, F.lit(fill[c])).alias(c)

    return df.select(*[value(c) for c in df.columns])


def impute_missing_values(df: DataFrame, num: Sequence[str], cat: Sequence[str], *, exact: bool = True) -> DataFrame:
    """Median or mode in place of missing values; columns that do not exist are ignored."""
    return filled(df, fit_fill(df, num, cat, exact=exact))


def iqr_bounds(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, *, exact: bool = True) -> DataFrame:
    """``(feature, lower, upper)``; a column without spread between its quartiles has no fence."""
    quarts = quantiles(df, present(df, cols), {"q1": 0.25, "q3": 0.75}, exact=exact)
    iqr = F.col("q3") - F.col("q1")
    return quarts.where(iqr != 0).select(
        "feature",
        (F.col("q1") - iqr * multiplier).alias("lower"),
        (F.col("q3") + iqr * multiplier).alias("upper"),
    )


def detect_outliers_iqr(
    df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, *, exact: bool = True
) -> dict[str, tuple[float, float]]:
    if not present(df, cols):
        return {}
    found = {r["feature"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, cols, multiplier, exact=exact).collect()}
    return {c: found[c] for c in cols if c in found}


def fit_numbers(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5) -> dict[str, dict]:
    """``median, lower, upper, min, max`` per column, of the column as filled with its median; one run of order statistics.

    Filling puts copies of the median in the middle of the known values. So the value at a rank of the filled column is the known value of that rank
    if it is below the median, the known value as many ranks before as there are copies if it is above, and the median otherwise.
    ``lower`` and ``upper`` are null for a column without spread between its quartiles; a column without known values has no entry.
    """
    cols = present(df, cols)
    if not cols:
        return {}
    shares, rows = {"q1": 0.25, "q3": 0.75}, F.col("rows")
    ranks = {"m0": lambda n: F.floor((n - 1) * 0.5), "m1": lambda n: F.ceil((n - 1) * 0.5)}
    for name, p in shares.items():
        for up in (0, 1):
            place = F.least(F.floor((rows - 1) * p) + up, rows - 1)
            ranks[f"{name}{up}a"] = lambda n, place=place: place
            ranks[f"{name}{up}b"] = lambda n, place=place: place - (rows - n)
    found = order_statistics(df, cols, ranks)
    at = [F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s) for s in ranks]
    wide = found.groupBy("feature", "rows", "n", "min", "max").agg(*at)
    middle = (F.col("n") - 1) * F.lit(0.5)
    wide = wide.withColumn("median", between(F.col("m0"), F.col("m1"), middle - F.floor(middle)))
    for name, p in shares.items():
        below, above = (
            F.when(F.col(f"{name}{up}a") < F.col("median"), F.col(f"{name}{up}a"))
            .when(F.col(f"{name}{up}b") > F.col("median"), F.col(f"{name}{up}b"))
            .otherwise(F.col("median"))
            for up in (0, 1)
        )
        place = (rows - 1) * F.lit(p)
        wide = wide.withColumn(name, between(below, above, place - F.floor(place)))
    iqr = F.col("q3") - F.col("q1")
    spread = wide.withColumns({
        "lower": F.when(iqr != 0, F.col("q1") - iqr * multiplier), "upper": F.when(iqr != 0, F.col("q3") + iqr * multiplier)
    })
    return {r["feature"]: r.asDict() for r in spread.select("feature", "median", "lower", "upper", "min", "max").collect()}


def treat_outliers_iqr(df: DataFrame, bounds: dict[str, tuple[float, float]], strategy: str = "clip") -> DataFrame:
    """Values limited to their fences."""
    if strategy != "clip":
        raise ValueError(f"unsupported outlier strategy {strategy!r}, only 'clip' is known")
    return df.withColumns({c: clip(number(f"`{c}`"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def fit_scale(df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of the columns to scale."""
    chosen = [c for c in present(df, cols) if c not in exclude]
    if not chosen:
        return {}
    found = {r["feature"]: (r["min"], r["max"]) for r in profile.ranges(df, chosen).collect()}
    return {c: found[c] for c in chosen}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """To 0..1; a constant column becomes 0. A column the scaler knows but the table lacks is an error."""
    missing = [c for c in scale if c not in df.columns]
    if missing:
        raise ValueError(f"columns of the fitted scaler are missing: {missing}")
    out = {}
    for c, (lo, hi) in scale.items():
        if lo is None:
            continue
        out[c] = (number(f"`{c}`") - lo) / ((hi - lo) or 1.0)
    return df.withColumns(out)


def normalize_numeric_features(
    df: DataFrame, cols: Sequence[str], exclude: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The scaled table and the fitted minima and maxima."""
    scale = fit_scale(df, cols, exclude or ())
    return scaled(df, scale), scale


def fit_categories(df: DataFrame, cols: Sequence[str], limit: int = 50) -> tuple[dict[str, list[str]], list[str]]:
    """Sorted categories of columns within the limit, and the columns above it.

    Sketches rule out identifier-like columns first, so only bounded value sets are ever collected.
    """
    cols = present(df, cols)
    if not cols:
        return {}, []
    rough = df.agg(*[F.approx_count_distinct(f"`{c}`", 0.02).alias(f"u{i}") for i, c in enumerate(cols)]).first()
    near = [c for c, u in zip(cols, rough) if u <= 2 * limit + 10]
    categories: dict[str, list[str]] = {}
    if near:
        sets = df.agg(*[F.array_sort(F.collect_set(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(near)]).first()
        categories = {c: list(s) for c, s in zip(near, sets) if len(s) <= limit}
    return categories, [c for c in cols if c not in categories]


def encoded(df: DataFrame, categories: dict[str, list[str]], dropped: Sequence[str]) -> DataFrame:
    """One flag per category, named ``<column>_<value>``; null has no flag set."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in categories and c not in dropped]
    flags = [
        F.coalesce(F.col(f"`{c}`") == v, F.lit(False)).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in values
    ]
    return df.select(*keep, *flags)


def encode_categorical_features(df: DataFrame, cols: Sequence[str], max_cardinality: int = 50) -> DataFrame:
    return encoded(df, *fit_categories(df, cols, max_cardinality))


@dataclass(frozen=True)
class PrepModel:
    """Everything the transform needs, and what it was fitted with."""

    categorical_cols: list[str]
    numerical_cols: list[str]
    fill: dict
    iqr_bounds: dict[str, tuple[float, float]]
    exclude_from_normalize: list[str]
    minmax: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]
    dropped: list[str]
    max_cardinality: int
    output_columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill, clip, scale and encode with the fitted numbers; a missing column is an error."""
        needed = [*self.numerical_cols, *self.categorical_cols]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"columns of the fitted preparation are missing: {missing}")
        clean = treat_outliers_iqr(filled(df, self.fill), self.iqr_bounds)
        return encoded(scaled(clean, self.minmax), self.categories, self.dropped)

    def params(self, spark: SparkSession) -> DataFrame:
        """Parameters as a table: one row per column."""
        rows = []
        for c in self.numerical_cols:
            lo, hi = self.iqr_bounds.get(c, (None, None))
            mn, mx = self.minmax.get(c, (None, None))
            rows.append((c, str(self.fill.get(c)), lo, hi, mn, mx, None))
        for c in self.categorical_cols:
            rows.append((c, self.fill.get(c), None, None, None, None, self.categories.get(c)))
        schema = (
            "feature string, fill string, lower double, upper double, min double, max double,"
            " categories array<string>"
        )
        return spark.createDataFrame(rows, schema)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> PrepModel:
        return cls(**json.loads(text))


def fit_prep(
    df: DataFrame,
    *,
    outliers_strategy: str = "clip",
    exclude_from_normalize: Sequence[str] | None = None,
    max_cardinality: int = 50,
    iqr_multiplier: float = 1.5,
    exact: bool = True,
) -> PrepModel:
    """Fit all steps; fences see filled values and the scaler sees clipped ones.

    An empty exclusion list means the defaults, as ``None`` does.
    """
    if outliers_strategy != "clip":
        raise ValueError(f"unsupported outlier strategy {outliers_strategy!r}, only 'clip' is known")
    cat, num = profile.split_feature_types(df)
    exclude = list(exclude_from_normalize or DEFAULT_UNSCALED)
    if exact:
        numbers = fit_numbers(df, num, iqr_multiplier)
        fill = {c: numbers[c]["median"] for c in num if c in numbers and numbers[c]["median"] is not None} | fit_fill(df, [], cat)
        full = filled(df, fill)
        bounds = {c: (x["lower"], x["upper"]) for c in num if (x := numbers.get(c)) and x["lower"] is not None}
        # The smallest and largest value after clipping are the clipped ones; the median lies between them.
        limits = {c: bounds.get(c, (x["min"], x["max"])) for c, x in numbers.items()}
        scale = {
            c: tuple(min(max(numbers[c][end], limits[c][0]), limits[c][1]) for end in ("min", "max")) if c in numbers else (None, None)
            for c in num if c not in exclude
        }
    else:
        fill = {c: v for c, v in fit_fill(df, num, cat, exact=False).items() if v is not None}
        full = filled(df, fill)
        bounds = detect_outliers_iqr(full, num, iqr_multiplier, exact=False)
        scale = fit_scale(treat_outliers_iqr(full, bounds), num, exclude)
    categories, dropped = fit_categories(full, cat, max_cardinality)
    kept = [c for c in df.columns if c not in categories and c not in dropped]
    names = kept + [f"{c}_{v}" for c, vs in categories.items() for v in vs]
    return PrepModel(cat, num, fill, bounds, exclude, scale, categories, dropped, max_cardinality, names)


def run_preprocessing(df: DataFrame, **settings) -> tuple[DataFrame, PrepModel]:
    """Fit on ``df`` and transform it."""
    model = fit_prep(df, **settings)
    return model.transform(df), model


def prep_report(before: DataFrame, after: DataFrame, model: PrepModel) -> DataFrame:
    """``(feature, nulls_before, nulls_after, outliers)``; encoded columns count no nulls after."""
    first = profile.null_profile(before).select("feature", F.col("nulls").alias("nulls_before"))
    second = profile.null_profile(after).select("feature", F.col("nulls").alias("nulls_after"))
    report = first.join(second, "feature", "left")
    if model.iqr_bounds:
        report = report.join(profile.outlier_counts(before, model.iqr_bounds), "feature", "left")
    else:
        report = report.withColumn("outliers", F.lit(None).cast("long"))
    return report.withColumn("nulls_after", F.coalesce("nulls_after", F.lit(0)))
