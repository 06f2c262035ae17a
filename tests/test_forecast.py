import datetime as dt

import numpy as np
import pytest

from obsflow.config import Config
from obsflow.operators import evaluate, forecast
from obsflow.operators.series import split_tail
from obsflow.plans.forecast_run import rolling_origins, run_forecast


def wave(n):
    i = np.arange(n)
    return 20 + 5 * np.sin(2 * np.pi * i / 7) + 0.03 * i


def path(df, key="global"):
    return [r["y_hat"] for r in df.where(f"key = '{key}'").orderBy("step").collect()]


def test_arima_equals_least_squares(series):
    y = np.cumsum(np.random.default_rng(0).normal(size=120)) + 50
    w = np.diff(y)
    x = np.column_stack([w[5 - k : len(w) - k] for k in range(1, 6)])
    phi = np.linalg.lstsq(x, w[5:], rcond=None)[0]
    past, level, want = list(w[::-1]), y[-1], []
    for _ in range(7):
        step = float(np.dot(phi, past[:5]))
        past, level = [step, *past], level + step
        want.append(level)
    assert path(forecast.arima_forecast(series(y), 7)) == pytest.approx(want, rel=1e-9)


def test_many_keys_at_once(series):
    both = series(wave(60), "a").unionByName(series(wave(60) + 100, "b"))
    got = forecast.arima_forecast(both, 5)
    a, b = path(got, "a"), path(got, "b")
    assert [y - x for x, y in zip(a, b)] == pytest.approx([100] * 5, rel=1e-6)


def test_sarima_follows_a_weekly_wave(series):
    rng = np.random.default_rng(4)
    y = wave(147) + rng.normal(0, 0.2, 147)
    rows = forecast.sarima_forecast(series(y[:140]), 7).orderBy("step").collect()
    assert np.max(np.abs(np.array([r["y_hat"] for r in rows]) - wave(147)[140:])) < 1.5
    assert len(rows) == 7 and rows[0]["status"] in ("ok", "fallback")


def test_stability_check():
    assert forecast.is_stable([0.5], [1]) and not forecast.is_stable([1.2], [1])


def test_seasonal_naive(series):
    got = path(forecast.seasonal_naive(series(range(20)), 10))
    assert got == [13, 14, 15, 16, 17, 18, 19, 13, 14, 15]
    assert path(forecast.seasonal_naive(series(range(20)), 3)) == [13, 14, 15]


def test_future_frame(series):
    rows = forecast.future_frame(series(range(5)), 3).orderBy("ds").collect()
    assert len(rows) == 8 and [r["is_future"] for r in rows[-4:]] == [False, True, True, True]
    assert rows[-1]["ds"] == dt.date(2024, 1, 8)


def test_trend_fourier_fits_trend_and_week(series):
    df = series(wave(200))
    got = forecast.trend_fourier(df, forecast.future_frame(df, 14)).orderBy("ds").collect()
    error = np.array([r["y_hat"] for r in got]) - wave(214)
    assert np.max(np.abs(error[:200])) < 0.3 and np.max(np.abs(error[200:])) < 1.5


def test_adf_tells_noise_from_a_walk(series):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=300)
    both = series(noise, "noise").unionByName(series(np.cumsum(noise), "walk"))
    got = {r["key"]: r for r in forecast.adf_test(both).collect()}
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]
    assert got["noise"]["crit_5pct"] == pytest.approx(-2.87, abs=0.01)


def plain_adf(y, max_lag=None):
    """The same test by least squares on whole matrices."""

    def regress(lags, drop):
        d = np.diff(y)
        rows = np.arange(drop, len(d))
        return np.column_stack([y[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))]), d[rows]

    most = max_lag if max_lag is not None else int(np.ceil(12.0 * (len(y) / 100.0) ** 0.25))
    most = max(0, min(most, len(y) // 2 - 3))
    best = (np.inf, 0)
    for lags in range(most + 1):
        x, d = regress(lags, most)
        rss, n = np.sum((d - x @ np.linalg.lstsq(x, d, rcond=None)[0]) ** 2), len(d)
        best = min(best, (2 * x.shape[1] + n * (np.log(2 * np.pi * rss / n) + 1), lags))
    x, d = regress(best[1], best[1])
    beta = np.linalg.lstsq(x, d, rcond=None)[0]
    variance = np.sum((d - x @ beta) ** 2) / (len(d) - x.shape[1])
    return len(d), best[1], beta[0] / np.sqrt(variance * np.linalg.inv(x.T @ x)[0, 0])


def test_adf_over_a_panel_equals_least_squares(series):
    rng = np.random.default_rng(6)
    panel = {f"k{n}": 1000 + np.cumsum(rng.normal(size=n)) + 3 * rng.normal(size=n) for n in (12, 40, 90, 250)}
    df = None
    for key, y in panel.items():
        df = series(y, key) if df is None else df.unionByName(series(y, key))
    for most in (None, 3):
        got = {r["key"]: r for r in forecast.adf_test(df.repartition(5), max_lag=most).collect()}
        for key, y in panel.items():
            n, lags, stat = plain_adf(y, most)
            assert (got[key]["n_obs"], got[key]["lags_used"]) == (n, lags)
            assert got[key]["adf"] == pytest.approx(stat, rel=1e-6)


def test_short_and_unknown_keys_keep_a_row(series):
    df = series([1.0, 2.0], "two").unionByName(series([None, None], "none")).unionByName(series(wave(60), "long"))
    adf = {r["key"]: r for r in forecast.adf_test(df).collect()}
    assert adf["two"]["adf"] is None and adf["long"]["adf"] is not None
    for model in (forecast.arima_forecast, forecast.sarima_forecast):
        got = {}
        for r in model(df, 3).orderBy("key", "step").collect():
            got.setdefault(r["key"], []).append((r["y_hat"], r["status"]))
        assert [s for _, s in got["two"]] == ["too short"] * 3 and [y for y, _ in got["two"]] == [2.0] * 3
        assert got["none"] == [(None, "too short")] * 3
        assert {s for _, s in got["long"]} <= {"ok", "fallback"} and len(got["long"]) == 3
    frame = forecast.future_frame(df, 2)
    trend = {r["key"]: r["n"] for r in forecast.trend_fourier(df, frame).where("y_hat is null").groupBy("key").count().withColumnRenamed("count", "n").collect()}
    assert trend == {"none": 4}


def test_batches_roll_out_like_single_keys():
    rng = np.random.default_rng(8)
    lags, season, steps = (1, 7, 8), 7, 12
    beta, phi = rng.normal(0, 0.3, (6, 6)), rng.normal(0, 0.1, (6, 14))
    y, w, e = rng.normal(size=(6, 8)), rng.normal(size=(6, 14)), rng.normal(size=(6, 8))
    stable = np.array([True, False] * 3)
    got = forecast.roll_out(beta, stable, phi, y, w, e, lags, season, steps)
    for n in range(6):
        a, b, c = list(y[n]), list(w[n]), list(e[n])
        for i in range(steps):
            terms = [b[k - 1] for k in lags] + [c[k - 1] for k in lags]
            new = float(np.dot(beta[n], terms)) if stable[n] else float(np.dot(phi[n], b[:14]))
            level = new + a[0] + a[season - 1] - a[season]
            a, b, c = [level, *a], [new, *b], [0.0, *c]
            assert got[n, i] == pytest.approx(level)
    for coefs in rng.normal(0, 0.6, (50, 3)):
        poly = np.zeros(9)
        poly[0] = 1.0
        for c, k in zip(coefs, lags, strict=True):
            poly[k] -= c
        assert forecast.is_stable(coefs, lags) == bool(np.all(np.abs(np.roots(poly)) < 1.0))


def test_weights_of_absent_models_go_to_the_others(spark):
    predictions = spark.createDataFrame([("k", 1, "a", 10.0), ("k", 1, "b", 20.0), ("k", 2, "a", 10.0), ("k", 3, "a", None), ("k", 3, "b", 8.0)], "key string, ds int, model_id string, y_hat double")
    weights = spark.createDataFrame([("k", "a", 0.75), ("k", "b", 0.25)], "key string, model_id string, weight double")
    got = {r["ds"]: r["y_hat"] for r in evaluate.weighted_ensemble(predictions, weights).collect()}
    assert got == {1: 12.5, 2: 10.0, 3: 8.0}


def test_pacf_against_regression(series):
    from obsflow.operators.series import autocorrelation

    y = np.random.default_rng(1).normal(size=400)
    for i in range(1, 400):
        y[i] += 0.7 * y[i - 1]
    acf = autocorrelation(series(y), 5)
    r = [x["acf"] for x in acf.orderBy("lag").collect()]
    want = [1.0]
    for k in range(1, 6):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    got = [x["pacf"] for x in forecast.partial_autocorrelation(acf).orderBy("lag").collect()]
    assert got == pytest.approx(want)


def test_best_round():
    assert forecast.best_round([3, 2, 1, 2, 2, 2], patience=3) == (3, True)
    assert forecast.best_round([3, 2, 1, 2], patience=3) == (3, False)
    assert forecast.best_round([1, 1, 1, 1], patience=3) == (1, True)


@pytest.fixture(scope="module")
def run(spark):
    rows = [("global", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(wave(100))]
    daily = spark.createDataFrame(rows, "key string, ds date, y double")
    config = Config(test_window_days=8, val_size=8)
    return {k: v.collect() for k, v in run_forecast(daily, config=config, boosting={"maxIter": 8, "stepSize": 0.3}).items()}


def test_run_scores_six_models(run):
    got = {r["model_id"]: r for r in run["metrics"]}
    assert set(got) == {"arima", "sarima", "lightgbm", "gradientboosting", evaluate.SIMPLE, evaluate.WEIGHTED}
    assert all(r["rmse_c"] >= 0 and r["mae_c"] >= 0 and r["mape_pct"] >= 0 for r in got.values())
    assert sum(r["weight"] for r in run["weights"]) == pytest.approx(1)
    assert got["sarima"]["rmse_c"] < 1.0
    assert len(run["predictions"]) == 6 * 8


def test_run_guards(series):
    with pytest.raises(ValueError):
        run_forecast(series(wave(50)), config=Config(test_window_days=0))
    with pytest.raises(Exception, match="series length"):
        run_forecast(series(wave(50)), config=Config(test_window_days=30, val_size=30))


def test_steps_land_on_holdout_rows(series):
    split = split_tail(series(range(20)), test=3)
    steps = forecast.seasonal_naive(split.where("split = 'train'"), 3)
    got = forecast.on_dates(steps, split.where("split = 'test'"), "naive").orderBy("ds").collect()
    assert [(str(r["ds"]), r["y_hat"]) for r in got] == [("2024-01-18", 10.0), ("2024-01-19", 11.0), ("2024-01-20", 12.0)]


def test_rolling_origins(series):
    rows = rolling_origins(series(range(20)), origins=2, horizon=5).collect()
    tests = {o: sorted(r["y"] for r in rows if r["origin"] == o and r["split"] == "test") for o in (0, 1)}
    assert tests == {0: [15, 16, 17, 18, 19], 1: [10, 11, 12, 13, 14]}
    assert max(r["y"] for r in rows if r["origin"] == 1 and r["split"] == "train") == 9


def test_the_first_rounds_of_a_model_equal_a_shorter_fit(spark):
    from pyspark.ml.regression import GBTRegressor

    from obsflow.operators import explain

    rng = np.random.default_rng(3)
    table = [(i, *map(float, x), float(x[0] - x[1] ** 2)) for i, x in enumerate(rng.normal(size=(150, 4)))]
    names = ["a", "b", "c", "d"]
    rows = explain.feature_rows(spark.createDataFrame(table, "id int, a double, b double, c double, d double, y double"), names, "y").cache()
    settings = {"maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 0.8, "seed": 5}
    cut = forecast.first_rounds(GBTRegressor(maxIter=9, **settings).fit(rows), 4)
    short = GBTRegressor(maxIter=4, **settings).fit(rows)
    a, b = ({r["id"]: r["prediction"] for r in m.transform(rows).collect()} for m in (cut, short))
    assert cut.getNumTrees == 4 and a == pytest.approx(b)
    got = explain.importances(rows, cut, names, "v").collect()
    assert [r["feature"] for r in got] == names and sum(r["v"] for r in got) == pytest.approx(1)
    shap, base = explain.tree_shap(rows.where("id < 3"), cut, names, id_cols=["id"])
    total = {r["id"]: base + r["s"] for r in shap.groupBy("id").sum("shap").withColumnRenamed("sum(shap)", "s").collect()}
    assert total == pytest.approx({i: a[i] for i in range(3)})
