"""Forecasters for many keyed series at once.

The autoregressive models are least squares per key: Spark sums the cross products of lagged columns
(one small matrix per key), and a batch of keys is solved and rolled out together. Boosted trees are
one pooled model over the feature rows of all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.operators.series import per_key
from obsflow.session import broadcast_if_small, checkpointed

# Fixed settings of the replaced models: orders, boosting parameters, early stopping.
AR_ORDER = 5
SEASON = 7
SAR_LAGS = (1, SEASON, SEASON + 1)
LONG_AR = 14
BOOSTED = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 2}
EARLY = {"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PATIENCE = 50
#: Status of the steps of a key that has too few days for its model.
SHORT = "too short"

STEPS_SCHEMA = "key string, step int, y_hat double, status string"


def gram(rows: DataFrame, xs: Sequence[str], y: str, *extra: Column) -> DataFrame:
    """Per key the cross products ``xx`` (upper triangle by rows), ``xy`` and the row count."""
    known = F.col(y).isNotNull()
    for x in xs:
        known = known & F.col(x).isNotNull()
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    return rows.groupBy("key").agg(
        F.count_if(known).alias("n"),
        F.array(*[F.sum(F.when(known, F.col(a) * F.col(b))) for a, b in pairs]).alias("xx"),
        F.array(*[F.sum(F.when(known, F.col(x) * F.col(y))) for x in xs]).alias("xy"),
        *extra,
    )


def newest(y: str, n: int, name: str) -> Column:
    """The last ``n`` values of a key, newest first."""
    latest = F.reverse(F.array_sort(F.collect_list(F.when(F.col("back") <= n, F.struct("ds", F.col(y).alias("v"))))))
    return F.transform(latest, lambda s: s["v"]).alias(name)


def with_back(rows: DataFrame) -> DataFrame:
    return rows.withColumn("back", F.row_number().over(W.partitionBy("key").orderBy(F.desc("ds"))))


def known_rows(series: DataFrame) -> DataFrame:
    return series.select("key", "ds", "y").where(F.col("y").isNotNull())


def ar_rows(series: DataFrame, p: int = AR_ORDER) -> DataFrame:
    """First differences ``w`` and their lags ``w1..wp``."""
    step = F.col("y") - F.lag("y").over(per_key())
    diffed = known_rows(series).withColumn("w", step)
    return diffed.withColumns({f"w{k}": F.lag("w", k).over(per_key()) for k in range(1, p + 1)})


def ar_gram(series: DataFrame, p: int = AR_ORDER) -> DataFrame:
    """``(key, n, xx, xy, y_last, w_last)``: all that the fit and the roll-out need."""
    xs = [f"w{k}" for k in range(1, p + 1)]
    return gram(with_back(ar_rows(series, p)), xs, "w", newest("y", 1, "y_last"), newest("w", p, "w_last"))


def stacked(column: pd.Series) -> np.ndarray:
    return np.array([np.array([np.nan if v is None else v for v in row], dtype=float) for row in column])


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares of a batch of normal equations given by upper triangles."""
    size = xy.shape[1]
    full = np.zeros((len(xx), size, size))
    upper = np.triu_indices(size)
    full[:, upper[0], upper[1]] = np.nan_to_num(xx)
    full[:, upper[1], upper[0]] = np.nan_to_num(xx)
    return np.einsum("nij,nj->ni", np.linalg.pinv(full, hermitian=True), np.nan_to_num(xy))


def step_rows(keys: pd.Series, paths: np.ndarray, status: Sequence[str]) -> pd.DataFrame:
    h = paths.shape[1]
    return pd.DataFrame(
        {
            "key": np.repeat(keys.to_numpy(), h),
            "step": np.tile(np.arange(1, h + 1), len(keys)),
            "y_hat": paths.reshape(-1),
            "status": np.repeat(np.array(status, dtype=object), h),
        }
    )


def arima_forecast(series: DataFrame, steps: int, *, p: int = AR_ORDER) -> DataFrame:
    """``(key, step, y_hat, status)`` of an autoregression of order ``p`` on first differences.

    Conditional least squares without a constant, in place of exact likelihood. A key that is too short for it repeats its last known value, with the
    status ``too short``; a key without a known value has steps without one.
    """

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            short = b["n"].to_numpy() <= p
            phi = solve(stacked(b["xx"]), stacked(b["xy"]))
            phi[short] = 0.0
            level = np.array([v[0] if len(v) else np.nan for v in b["y_last"]], float)
            w = np.array([np.pad(np.asarray(v, float), (0, p - len(v))) for v in b["w_last"]]).reshape(len(b), p)
            w = np.nan_to_num(w)
            path = np.zeros((len(b), steps))
            for i in range(steps):
                new = np.einsum("np,np->n", phi, w)
                level = level + new
                w = np.column_stack([new, w[:, :-1]])
                path[:, i] = level
            yield step_rows(b["key"], path, np.where(short, SHORT, "ok"))

    return _with_all_keys(series, ar_gram(series, p).mapInPandas(roll, STEPS_SCHEMA), steps)


def _with_all_keys(series: DataFrame, found: DataFrame, steps: int) -> DataFrame:
    """Adds the keys that ``found`` has no steps for: their last known value, and null if there is none."""
    last = series.groupBy("key").agg(F.max_by("y", F.when(F.col("y").isNotNull(), F.col("ds"))).alias("y_hat"))
    missing = last.join(found.select("key").distinct(), "key", "left_anti")
    ahead = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return found.unionByName(missing.select("key", ahead, "y_hat", F.lit(SHORT).alias("status")))


def sarima_forecast(series: DataFrame, steps: int, *, season: int = SEASON, long_ar: int = LONG_AR) -> DataFrame:
    """``(key, step, y_hat, status)`` of a seasonal autoregressive moving-average regression.

    The series is differenced at 1 and ``season``; a long autoregression gives the residuals, and the
    final regression uses lags 1, ``season`` and ``season + 1`` of series and residuals (two-stage
    least squares after Hannan and Rissanen 1982; the multiplicative terms become additive lags). A
    key whose fit is not stable falls back to the long autoregression and says so in ``status``; a key that is too short repeats its last known value.
    """
    lags = (1, season, season + 1)
    deep = max(long_ar, season + 1)
    w = F.col("y") - F.lag("y", 1).over(per_key()) - F.lag("y", season).over(per_key()) + F.lag("y", season + 1).over(per_key())
    rows = known_rows(series).withColumn("w", w)
    rows = rows.withColumns({f"w{k}": F.lag("w", k).over(per_key()) for k in range(1, long_ar + 1)})
    first = gram(rows, [f"w{k}" for k in range(1, long_ar + 1)], "w")

    def first_stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not b.empty:
                phi = solve(stacked(b["xx"]), stacked(b["xy"]))
                yield pd.DataFrame({"key": b["key"], "phi": list(phi)})

    phis = broadcast_if_small(first.where(F.col("n") > long_ar).mapInPandas(first_stage, "key string, phi array<double>"))
    fitted = sum((F.col("phi")[k - 1] * F.col(f"w{k}") for k in range(1, long_ar + 1)), F.lit(0.0))
    staged = rows.join(phis, "key").withColumn("e", F.col("w") - fitted)
    staged = staged.withColumns({f"e{k}": F.lag("e", k).over(per_key()) for k in lags})
    xs = [f"w{k}" for k in lags] + [f"e{k}" for k in lags]
    second = gram(
        with_back(staged), xs, "w", F.first("phi").alias("phi"),
        newest("y", season + 1, "y_last"), newest("w", deep, "w_last"), newest("e", season + 1, "e_last"),
    ).where(F.col("n") > len(xs))

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            beta = solve(stacked(b["xx"]), stacked(b["xy"]))
            stable = are_stable(beta[:, : len(lags)], lags) & are_stable(-beta[:, len(lags) :], lags)
            paths = roll_out(beta, stable, stacked(b["phi"]), *(np.nan_to_num(padded(b[c], n)) for c, n in (("y_last", season + 1), ("w_last", deep), ("e_last", season + 1))), lags, season, steps)
            yield step_rows(b["key"], paths, np.where(stable, "ok", "fallback"))

    return _with_all_keys(series, second.mapInPandas(roll, STEPS_SCHEMA), steps)


def padded(column: pd.Series, n: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    return np.array([np.pad(np.asarray([0.0 if x is None else x for x in v], float), (0, n - len(v))) for v in column]).reshape(len(column), n)


def are_stable(coefs: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Per row whether all roots of the lag polynomial lie outside the unit circle: whether its companion matrix has no larger eigenvalue than one."""
    n = max(lags)
    companion = np.zeros((len(coefs), n, n))
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1.0
    companion[:, 0, np.array(lags) - 1] = np.nan_to_num(coefs)
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1.0 if len(coefs) else np.zeros(0, bool)


def is_stable(coefs: Sequence[float], lags: Sequence[int]) -> bool:
    return bool(are_stable(np.array([coefs], float), lags)[0])


def roll_out(beta: np.ndarray, stable: np.ndarray, phi: np.ndarray, y: np.ndarray, w: np.ndarray, e: np.ndarray, lags: Sequence[int],
             season: int, steps: int) -> np.ndarray:
    """Recursive forecasts of a batch of keys (rows; newest values first); keys that are not stable go by the long autoregression ``phi``."""
    at = np.array(lags) - 1
    out = np.zeros((len(beta), steps))
    for i in range(steps):
        short = np.einsum("nk,nk->n", beta, np.column_stack([w[:, at], e[:, at]]))
        long = np.einsum("nk,nk->n", phi, w[:, : phi.shape[1]])
        new = np.where(stable, short, long)
        level = new + y[:, 0] + y[:, season - 1] - y[:, season]
        y, w = np.column_stack([level, y[:, :-1]]), np.column_stack([new, w[:, :-1]])
        e = np.column_stack([np.zeros(len(e)), e[:, :-1]])
        out[:, i] = level
    return out


def seasonal_naive(series: DataFrame, steps: int, *, season: int = SEASON) -> DataFrame:
    """``(key, step, y_hat, status)``: the last season repeated."""
    rows = with_back(known_rows(series)).where(F.col("back") <= season)
    size = F.count("*").over(W.partitionBy("key"))
    place = rows.withColumns({"size": size, "place": size - F.col("back") + 1})
    repeated = F.explode(F.sequence(F.col("place"), F.lit(max(steps, season)), F.col("size")))
    return (
        place.select("key", repeated.alias("step"), F.col("y").alias("y_hat"))
        .where(F.col("step") <= steps)
        .select("key", F.col("step").cast("int").alias("step"), "y_hat", F.lit("ok").alias("status"))
    )


def on_dates(forecast: DataFrame, holdout: DataFrame, model_id: str) -> DataFrame:
    """Step ``i`` laid on the ``i``-th row of the key's holdout: ``(key, ds, model_id, y_hat)``."""
    numbered = holdout.select("key", "ds", F.row_number().over(per_key()).alias("step"))
    return numbered.join(forecast, ["key", "step"]).select("key", "ds", F.lit(model_id).alias("model_id"), "y_hat")


def future_frame(series: DataFrame, periods: int = 30, *, history: bool = True) -> DataFrame:
    """``(key, ds, is_future)``: the days of every key, followed by ``periods`` new days."""
    last = series.groupBy("key").agg(F.max("ds").alias("last"))
    days = F.sequence(F.date_add("last", 1), F.date_add("last", periods))
    ahead = last.select("key", F.explode(days).alias("ds"), F.lit(True).alias("is_future"))
    if not history:
        return ahead
    return series.select("key", "ds", F.lit(False).alias("is_future")).unionByName(ahead)


def partial_grams(rows: DataFrame, design: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(key, n, xx, xy, yy)``: cross products of the design of a key's rows, one row per key and batch.

    ``design`` turns rows of one key into a matrix and a target; rows of a key may be in any number of batches, and the sums of the
    matrices over them are those of all rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for key, part in b.groupby("key", sort=False, dropna=False):
                x, y = design(part)
                if len(x):
                    found.append((key, len(x), (x.T @ x).ravel(), x.T @ y, float(y @ y)))
            if found:
                yield pd.DataFrame(found, columns=["key", "n", "xx", "xy", "yy"])

    return rows.mapInPandas(run, "key string, n long, xx array<double>, xy array<double>, yy double")


def summed_grams(parts: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, float]:
    """The cross products of all rows of a key from those of its parts."""
    xy = np.sum(np.stack(parts["xy"].to_numpy()), axis=0)
    xx = np.sum(np.stack(parts["xx"].to_numpy()), axis=0).reshape(len(xy), len(xy))
    return int(parts["n"].sum()), xx, xy, float(parts["yy"].sum())


def trend_fourier(
    series: DataFrame, frame: DataFrame, *, changepoints: int = 25, changepoint_range: float = 0.8,
    yearly: int = 10, weekly: int = 3, ridge: float = 20.0,
) -> DataFrame:
    """``(key, ds, y_hat)`` of a piecewise linear trend with yearly and weekly terms.

    Fits ``series`` and predicts the days of ``frame``. The rows of a key become cross products where they are, only these matrices are
    put together and solved per key, and days are predicted row by row. ``ridge`` holds the changes of slope down. A key with fewer than two known
    days has rows without a prediction.
    """
    knots = np.linspace(0, changepoint_range, changepoints + 1)[1:]
    size = 2 + changepoints + 2 * (yearly + weekly)

    def design(rows: pd.DataFrame) -> np.ndarray:
        d = rows["day"].to_numpy(float)
        t = (d - rows["start"].to_numpy(float)) / rows["span"].to_numpy(float)
        cols = [np.ones_like(t), t] + [np.maximum(t - k, 0.0) for k in knots]
        for period, order in ((365.25, yearly), (7.0, weekly)):
            for i in range(1, order + 1):
                cols += [np.sin(2 * np.pi * i * d / period), np.cos(2 * np.pi * i * d / period)]
        return np.column_stack(cols)

    def number_of(day: Column | str) -> Column:  # days since the first of January of the year 1, from 1
        return F.datediff(day, F.lit("1970-01-01").cast("date")) + 719163

    first, last = F.min(number_of("ds")), F.max(number_of("ds"))
    known = known_rows(series)
    about = known.groupBy("key").agg(
        first.alias("start"), F.greatest(last - first, F.lit(1)).alias("span"),
        F.greatest(F.max(F.abs("y")), F.lit(1e-9)).alias("scale"), F.count("*").alias("known"),
    )
    about = broadcast_if_small(about.where("known >= 2").drop("known"))
    parts = partial_grams(
        known.join(about, "key").select("key", number_of("ds").alias("day"), "start", "span", (F.col("y") / F.col("scale")).alias("y")),
        lambda rows: (design(rows), rows["y"].to_numpy(float)),
    )
    penalty = np.full(size, 0.01)
    penalty[:2], penalty[2 : 2 + changepoints] = 0.0, ridge

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        _, xx, xy, _ = summed_grams(rows)
        beta = np.linalg.lstsq(xx + np.diag(penalty), xy, rcond=None)[0]
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "beta": [beta]})

    betas = parts.groupBy("key").applyInPandas(fit, "key string, beta array<double>")
    wanted = frame.select("key", "ds", number_of("ds").alias("day")).join(broadcast_if_small(about.join(betas, "key")), "key", "left")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["key", "ds"]].assign(y_hat=np.nan)
            fitted = b["beta"].notna().to_numpy()
            if fitted.any():
                some = b[fitted]
                y = np.einsum("nd,nd->n", design(some), np.stack(some["beta"].to_numpy())) * some["scale"].to_numpy(float)
                out.loc[fitted, "y_hat"] = y
            yield out

    found = wanted.mapInPandas(predict, "key string, ds date, y_hat double")
    return found.withColumn("y_hat", F.nanvl("y_hat", F.lit(None).cast("double")))


# Fixed values, published by MacKinnon (1994, 2010) for a test with a constant: response surfaces of
# the critical values and of the p-value below and above the switch point.
ADF_CRITICAL = {
    "crit_1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10pct": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_test(series: DataFrame, *, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic per key with a constant, lag order by AIC.

    ``(key, n_obs, lags_used, adf, crit_1pct, crit_5pct, crit_10pct, stationary)``; the verdict compares with the 5 % value. The differences, their lags and the
    level before become cross products where the rows are; all orders are compared on sub-matrices of their sum, and the chosen one is refitted with the few
    first rows that longer lags leave out. A key that is too short has a row without a statistic.
    """
    rows = known_rows(series)
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.avg("y").alias("mean"))
    rule = F.ceil(12.0 * F.pow(F.col("size") / 100.0, F.lit(0.25))).cast("int") if max_lag is None else F.lit(max_lag)
    sizes = checkpointed(sizes.withColumn("most", F.greatest(F.lit(0), F.least(rule, F.floor(F.col("size") / 2).cast("int") - 3))))
    widest = sizes.agg(F.max("most")).first()[0] or 0
    step = F.col("y") - F.lag("y").over(per_key())
    stepped = rows.withColumns({"d": step, "level": F.lag("y").over(per_key()), "i": F.row_number().over(per_key()) - 2})
    lags = [F.lag("d", k).over(per_key()) for k in range(1, widest + 1)]
    lagged = stepped.select("key", "i", "d", "level", F.array(*lags).cast("array<double>").alias("lags")).where("i >= 0")
    # The constant takes up a shift of the level, and near zero the products are well conditioned.
    lagged = lagged.join(broadcast_if_small(sizes), "key").withColumn("level", F.col("level") - F.col("mean"))

    def matrix(part: pd.DataFrame, lags_used: int) -> np.ndarray:
        past = np.array([np.asarray(v, float) for v in part["lags"]]).reshape(len(part), -1)[:, :lags_used]
        return np.column_stack([part["level"].to_numpy(float), past, np.ones(len(part))])

    def design(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        most = int(part["most"].iloc[0])
        full = part[part["i"] >= most]
        return matrix(full, most), full["d"].to_numpy(float)

    parts = partial_grams(lagged, design)
    head = F.array_sort(F.collect_list(F.when(F.col("i") < F.col("most"), F.struct("i", "d", "level", "lags"))))
    heads = lagged.groupBy("key").agg(head.alias("head"))  # at most as many rows as lags

    def fit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        most, first = int(right["most"].iloc[0]), right["head"].iloc[0]
        n, xx, xy, yy = summed_grams(left) if len(left) else (0, np.zeros((most + 2, most + 2)), np.zeros(most + 2), 0.0)

        def chosen(lags_used: int) -> list[int]:
            return [*range(lags_used + 1), most + 1]

        def residual(xx: np.ndarray, xy: np.ndarray, yy: float) -> tuple[np.ndarray, np.ndarray, float]:
            inverse = np.linalg.pinv(xx, hermitian=True)
            beta = inverse @ xy
            return beta, inverse, max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)

        best = (np.inf, 0)
        for lags_used in range(most + 1) if n else ():
            at = chosen(lags_used)
            rss = residual(xx[np.ix_(at, at)], xy[at], yy)[2]
            log_likelihood = -n / 2 * (np.log(2 * np.pi * max(rss, 1e-300) / n) + 1)
            best = min(best, (2 * len(at) - 2 * log_likelihood, lags_used))
        lags_used = best[1]
        at = chosen(lags_used)
        xx, xy = xx[np.ix_(at, at)], xy[at]
        more = [r for r in first if r is not None and r["i"] >= lags_used] if first is not None else []
        for r in more:
            x = np.array([r["level"], *r["lags"][:lags_used], 1.0], float)
            xx, xy, yy, n = xx + np.outer(x, x), xy + x * r["d"], yy + r["d"] ** 2, n + 1
        row = {"key": right["key"].iloc[0], "n_obs": n, "lags_used": lags_used}
        if n <= len(at):
            return pd.DataFrame([{**row, "adf": None, **dict.fromkeys(ADF_CRITICAL), "stationary": None}])
        beta, inverse, rss = residual(xx, xy, yy)
        stat = beta[0] / np.sqrt(max(rss / (n - len(at)) * inverse[0, 0], 1e-300))
        crit = {name: sum(b / n**i for i, b in enumerate(bs)) for name, bs in ADF_CRITICAL.items()}
        return pd.DataFrame([{**row, "adf": stat, **crit, "stationary": bool(stat < crit["crit_5pct"])}])

    schema = (
        "key string, n_obs int, lags_used int, adf double, crit_1pct double, crit_5pct double,"
        " crit_10pct double, stationary boolean"
    )
    about = sizes.join(heads, "key", "left").select("key", "most", "head")
    return parts.groupBy("key").cogroup(about.groupBy("key")).applyInPandas(fit, schema)


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """``(key, lag, pacf)`` from ``(key, lag, acf)`` by the Durbin-Levinson recursion."""
    curves = acf.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"))

    def recurse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            r = stacked(b["r"])
            out = np.ones_like(r)
            phi = np.zeros((len(r), 0))
            for k in range(1, r.shape[1]):
                past = r[:, k - 1 : 0 : -1]
                top = r[:, k] - np.sum(phi * past, axis=1)
                low = 1.0 - np.sum(phi * r[:, 1:k], axis=1)
                new = np.divide(top, low, out=np.zeros_like(top), where=low != 0)
                phi = np.column_stack([phi - new[:, None] * phi[:, ::-1], new])
                out[:, k] = new
            yield pd.DataFrame(
                {"key": np.repeat(b["key"].to_numpy(), r.shape[1]), "lag": np.tile(np.arange(r.shape[1]), len(b)), "pacf": out.reshape(-1)}
            )

    return curves.mapInPandas(recurse, "key string, lag int, pacf double")


def assembled(rows: DataFrame, features: Sequence[str], label: str = "y") -> DataFrame:
    """Rows with all features known, as a vector column beside the label."""
    known = rows.dropna(subset=[*features])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(
        known.withColumn("label", F.col(label).cast("double"))
    )


def train_gradient_boosting(rows: DataFrame, *, seed: int = 42, **params) -> GBTRegressionModel:
    """Boosted trees on assembled rows with the fixed settings, unless overridden."""
    return GBTRegressor(seed=seed, **{**BOOSTED, **params}).fit(rows)


def best_round(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds to keep, and whether ``patience`` rounds without progress were seen after them."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def train_early_stopped(
    train: DataFrame, val: DataFrame, *, seed: int = 42, patience: int = PATIENCE, **params
) -> tuple[GBTRegressionModel, int]:
    """Boosted trees cut at the best validation round; ``(model, rounds)``.

    The first rounds of a longer fit equal a shorter fit with the same seed, so the number of rounds
    is doubled only while the validation error has not yet stood still for ``patience`` rounds.
    """
    settings = {**EARLY, **params}
    most = settings.pop("maxIter")
    rounds = min(patience + 16, most)
    while True:
        model = GBTRegressor(seed=seed, maxIter=rounds, **settings).fit(train)
        kept, settled = best_round(model.evaluateEachIteration(val, "squared"), patience)
        if settled or rounds >= most:
            break
        rounds = min(2 * rounds, most)
    return first_rounds(model, kept), kept


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model as it was after so many rounds: its first trees, as a new model of their own."""
    if rounds >= model.getNumTrees:
        return model
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(ml.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(model._java_obj.trees(), model.treeWeights[:rounds])):
        trees[i], weights[i] = tree, weight
    return GBTRegressionModel(ml.GBTRegressionModel(model.uid, trees, weights))


def model_predictions(model, rows: DataFrame, model_id: str) -> DataFrame:
    return model.transform(rows).select("key", "ds", F.lit(model_id).alias("model_id"), F.col("prediction").alias("y_hat"))
