import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsflow.functions.scalar import clip
from obsflow.operators import prep, profile


@pytest.fixture
def sample(spark):
    rows = [(20.0, 50.0, "A", "X"), (25.0, 60.0, "B", "X"), (None, 70.0, None, "Y"), (30.0, None, "A", "Y"), (100.0, 80.0, "C", "Z")]
    return spark.createDataFrame(rows, "temperature double, humidity double, city string, country string")


@pytest.fixture
def numeric(spark):
    rows = list(zip([1.0, 2.0, 3.0, 4.0, 100.0], [10.0, 20.0, 30.0, 40.0, 50.0]))
    return spark.createDataFrame(rows, "value1 double, value2 double")


def column(df, c):
    return [r[c] for r in df.select(c).collect()]


def test_types_leave_out_booleans_and_times(spark):
    df = spark.sql("select 'a' s, 1 i, 1.5D d, true b, current_timestamp() t")
    assert profile.split_feature_types(df) == (["s"], ["i", "d"])


def test_impute(sample):
    full = prep.impute_missing_values(sample, ["temperature", "humidity", "none"], ["city"])
    assert column(full, "temperature")[2] == 27.5 and column(full, "humidity")[3] == 65.0 and column(full, "city")[2] == "A"


def test_impute_without_known_values(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "v double, s string")
    full = prep.impute_missing_values(df, ["v"], ["s"])
    assert column(full, "v") == [None, None] and column(full, "s") == ["", ""]


def test_fences(numeric):
    near = prep.detect_outliers_iqr(numeric, ["value1", "absent"])
    assert near == {"value1": (-1.0, 7.0)}
    wide = prep.detect_outliers_iqr(numeric, ["value1"], 3.0)
    assert wide["value1"][1] > near["value1"][1]


def test_zero_inflated_column_survives(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(5.0,), (10.0,)], "rain double")
    bounds = prep.detect_outliers_iqr(df, ["rain"])
    assert bounds == {} and max(column(prep.treat_outliers_iqr(df, bounds), "rain")) == 10.0


def test_clip_and_unknown_strategy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "v double")
    assert column(prep.treat_outliers_iqr(df, {"v": (0.0, 10.0)}), "v") == [1.0, 2.0, 3.0, 10.0, None]
    with pytest.raises(ValueError):
        prep.treat_outliers_iqr(df, {}, "drop")


def test_scale(numeric, spark):
    scaled, fitted = prep.normalize_numeric_features(numeric, ["value1", "value2"], ["value2"])
    assert list(fitted) == ["value1"] and min(column(scaled, "value1")) == 0 and max(column(scaled, "value1")) == 1
    assert column(scaled, "value2") == [10.0, 20.0, 30.0, 40.0, 50.0]
    constant = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert column(prep.normalize_numeric_features(constant, ["v"])[0], "v") == [0.0, 0.0]


def test_cardinality_limit(spark):
    df = spark.createDataFrame([(f"id{i}", "A" if i < 30 else "B") for i in range(60)], "id string, cat string")
    assert prep.encode_categorical_features(df, ["id", "cat"]).columns == ["cat_A", "cat_B"]
    assert len(prep.encode_categorical_features(df, ["id", "cat"], 100).columns) == 62


def test_null_category_has_no_flag(spark):
    df = spark.createDataFrame([("A",), (None,)], "c string")
    assert sorted(column(prep.encode_categorical_features(df, ["c"]), "c_A")) == [False, True]


def test_full_preparation(sample):
    clean, model = prep.run_preprocessing(sample)
    assert clean.columns == model.output_columns
    assert {"city_A", "country_Z"} <= set(clean.columns)
    assert profile.null_profile(clean).agg(F.sum("nulls")).first()[0] == 0
    again = prep.PrepModel.from_json(model.to_json())
    assert again.transform(sample).collect() == clean.collect()
    with pytest.raises(ValueError, match="humidity"):
        model.transform(sample.drop("humidity"))


def test_empty_exclusion_means_defaults(sample):
    assert prep.fit_prep(sample, exclude_from_normalize=[]).exclude_from_normalize == prep.DEFAULT_UNSCALED


def test_transform_uses_fitted_numbers(spark):
    train = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    model = prep.fit_prep(train)
    assert column(model.transform(spark.createDataFrame([(20.0,), (None,)], "v double")), "v") == [1.5, 0.5]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=20), st.floats(-50, 0), st.floats(0, 50))
def test_clip_is_idempotent_and_keeps_nulls(spark, xs, lo, hi):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    once = df.select(clip("v", lo, hi).alias("v"))
    a, b = column(once, "v"), column(once.select(clip("v", lo, hi).alias("v")), "v")
    assert a == b == [None if x is None else min(max(x, lo), hi) for x in xs]
