import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.operators import conformal, drift, evaluate


def scored(spark, y, y_hat, model="m", key="k"):
    return spark.createDataFrame([(key, model, float(a), float(b)) for a, b in zip(y, y_hat)], "key string, model_id string, y double, y_hat double")


def test_metrics(spark):
    row = evaluate.compute_metrics(scored(spark, [1, 2, 3], [1, 2, 5])).first()
    assert row["rmse_c"] == pytest.approx((4 / 3) ** 0.5)
    assert evaluate.compute_metrics(scored(spark, [1, 2, 3], [1, 4, 3])).first()["mae_c"] == pytest.approx(2 / 3)
    assert evaluate.compute_metrics(scored(spark, [0, 2], [5, 3])).first()["mape_pct"] == 50.0
    assert evaluate.compute_metrics(scored(spark, [0, 0], [5, 3])).first()["mape_pct"] is None


def test_ensembles(spark):
    rows = [("k", "2024-01-01", "a", 1.0), ("k", "2024-01-02", "a", 2.0), ("k", "2024-01-01", "b", 3.0), ("k", "2024-01-02", "b", 4.0)]
    p = spark.createDataFrame(rows, "key string, ds string, model_id string, y_hat double")
    w = spark.createDataFrame([("k", "a", 0.25), ("k", "b", 0.75)], "key string, model_id string, weight double")
    assert [r["y_hat"] for r in evaluate.weighted_ensemble(p, w).orderBy("ds").collect()] == [2.5, 3.5]
    assert [r["y_hat"] for r in evaluate.simple_average(p).orderBy("ds").collect()] == [2.0, 3.0]


def test_weights_sum_to_one(spark):
    m = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "key string, model_id string, rmse_c double")
    w = {r["model_id"]: r["weight"] for r in evaluate.inverse_rmse_weights(m).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["a"] > w["b"]


def test_best_model_ignores_pending(spark):
    rows = [("k", "b", 1.0, "final"), ("k", "a", 1.0, "final"), ("k", "c", 0.1, "pending_rerun"), ("k", "d", None, "final")]
    m = spark.createDataFrame(rows, "key string, model_id string, rmse_c double, status string")
    row = evaluate.best_model(m).first()
    assert (row["best_id"], row["max_rmse"]) == ("a", 1.0)


def test_alignment(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "key string, ds int")
    b = spark.createDataFrame([("k", 2), ("k", 3)], "key string, ds int")
    row = evaluate.alignment(a, b).first()
    assert (row["only_a"], row["only_b"], row["aligned"]) == (1, 1, False)
    assert evaluate.alignment(a, a).first()["aligned"]


def residuals(spark, values, key="k"):
    return spark.createDataFrame([(key, float(v)) for v in values], "key string, residual double")


@pytest.mark.parametrize("values, alpha, want", [(range(1, 11), 0.2, 9.0), ([2, 5, 1, 4], 0.1, 5.0), ([3], 0.5, 3.0)])
def test_conformal_quantile(spark, values, alpha, want):
    assert conformal.conformal_quantile(residuals(spark, values), alpha).first()["q"] == want


def test_conformal_errors(spark):
    for alpha in (0, 1, -0.1, 1.5):
        with pytest.raises(ValueError, match="alpha"):
            conformal.conformal_quantile(residuals(spark, [1.0]), alpha)
    with pytest.raises(ValueError, match="empty"):
        conformal.conformal_quantile(residuals(spark, []), 0.1)


def test_interval_and_coverage(spark):
    q = spark.createDataFrame([("k", 2.5)], "key string, q double")
    row = conformal.prediction_intervals(scored(spark, [0], [10]), q).first()
    assert (row["lower"], row["upper"]) == (7.5, 12.5)
    rows = [("k", 1.0, 0.0, 1.5), ("k", 2.0, 0.0, 1.5), ("k", 3.0, 0.0, 3.5), ("k", 4.0, 0.0, 3.5)]
    bands = spark.createDataFrame(rows, "key string, y double, lower double, upper double")
    assert conformal.empirical_coverage(bands).first()["coverage"] == 0.5


def test_coverage_holds(spark):
    rng = np.random.default_rng(0)
    truth = rng.normal(size=3000)
    noisy = truth + rng.normal(size=3000)
    calibration = conformal.calibration_residuals(scored(spark, truth[:1000], noisy[:1000]))
    q = conformal.conformal_quantile(calibration, 0.1)
    bands = conformal.prediction_intervals(scored(spark, truth[1000:], noisy[1000:]), q)
    assert conformal.empirical_coverage(bands).first()["coverage"] >= 0.87


def two_samples(spark, a, b, c=None):
    rows = [(True, float(x), float(x)) for x in a] + [(False, float(x), float(y)) for x, y in zip(b, c if c is not None else b)]
    return spark.createDataFrame(rows, "ref boolean, v double, w double")


def brute_d(a, b):
    at = np.concatenate([a, b])
    fa = np.searchsorted(np.sort(a), at, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), at, side="right") / len(b)
    return np.max(np.abs(fa - fb))


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), np.concatenate([rng.normal(0.2, 2, 400), np.full(300, 0.5)])
    row = drift.drift_report(two_samples(spark, a, b), ["v"], F.col("ref"), slices=7).first()
    assert row["d"] == pytest.approx(brute_d(a, b), abs=1e-12)


def test_exact_p_value_by_enumeration(spark):
    from itertools import combinations

    a, b = [1.0, 2.0, 3.0, 7.0], [4.0, 5.0, 6.0, 8.0]
    pool, d = np.arange(8.0), brute_d(a, b)
    splits = [(pool[list(c)], np.delete(pool, c)) for c in combinations(range(8), 4)]
    want = np.mean([brute_d(x, y) >= d - 1e-12 for x, y in splits])
    row = drift.drift_report(two_samples(spark, a, b), ["v"], F.col("ref"), method="exact").first()
    assert row["p_value"] == pytest.approx(want)
    with pytest.raises(ValueError, match="method"):
        drift.ks_p_value(F.lit(0.5), F.lit(3), F.lit(3), method="size")


@pytest.mark.parametrize("kind", ["shifted", "same", "hot", "infinite"])
def test_only_slices_that_can_hold_the_distance_are_open(spark, kind):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=3000), rng.normal(0.5 if kind == "shifted" else 0, 1, 3000)
    if kind == "hot":
        a[:1000] = b[:1400] = 0.25
    if kind == "infinite":
        a[:30], b[:200], b[200:220] = -np.inf, -np.inf, np.inf
    df = two_samples(spark, a, b)
    assert drift.ks_statistics(df, ["v"], F.col("ref"), slices=40).first()["d"] == pytest.approx(brute_d(a, b), abs=1e-12)
    ends = drift.open_slices(drift.counted_values(df, ["v"], F.col("ref"), 40)).collect()
    opened = sum(r["open"] for r in ends)
    assert len(ends) >= 30 and (opened < 15 if kind in ("shifted", "hot") else opened <= len(ends))


def test_a_side_without_values_has_no_distance(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, None)], "ref boolean, v double")
    row = drift.drift_report(df, ["v"], F.col("ref")).first()
    assert (row["n_ref"], row["n_cur"], row["d"], row["p_value"]) == (2, 0, None, None)


def test_drift_verdicts(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(20, 1, 300)
    shifted = drift.drift_report(two_samples(spark, a, a + 5, a), ["v", "w"], F.col("ref"))
    got = {r["feature"]: r["drifted"] for r in shifted.collect()}
    assert got == {"v": True, "w": False}
    row = drift.drift_summary(shifted).first()
    assert (row["columns"], row["drifted_columns"], row["share"], row["dataset_drift"]) == (2, 1, 0.5, True)
    same = drift.drift_summary(drift.drift_report(two_samples(spark, a, a), ["v"], F.col("ref"))).first()
    assert not same["dataset_drift"]


def test_empty_report_is_an_error(spark):
    empty = spark.createDataFrame([], "feature string, drifted boolean")
    with pytest.raises(Exception, match="no tested column"):
        drift.drift_summary(empty).collect()
