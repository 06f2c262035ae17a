import datetime as dt

import pytest

from obsflow.config import Config
from obsflow.sources import registry, synthetic
from obsflow.sources import tables as src


def write(path, text):
    path.write_text(text)
    return path


def test_missing_file_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.load_observations(spark, tmp_path / "absent.csv")


def test_missing_columns_are_all_named(spark, tmp_path):
    path = write(tmp_path / "a.csv", "country\nX\n")
    with pytest.raises(ValueError, match="last_updated.*temperature_celsius"):
        src.load_observations(spark, path)


def test_bad_times_are_dropped_and_rows_sorted(spark, tmp_path):
    text = "last_updated,temperature_celsius\n2024-01-03 00:00,3\nnot a time,9\n2024-01-01 00:00,1\n2024-01-02 00:00,2\n"
    path = write(tmp_path / "a.csv", text)
    got = src.load_observations(spark, path, schema="last_updated string, temperature_celsius double")
    assert [r["temperature_celsius"] for r in got.collect()] == [1.0, 2.0, 3.0]


def test_region_falls_back_per_row(spark):
    rows = [("North America", "America/New_York"), (None, "Asia/Tokyo"), ("Europe", "Europe/London"), (None, None)]
    df = spark.createDataFrame(rows, "continent string, timezone string")
    assert [r["region"] for r in src.add_region_column(df).collect()] == ["North America", "Asia", "Europe", "Unknown"]
    assert src.add_region_column(df.drop("continent", "timezone")).first()["region"] == "Unknown"
    zones = src.add_region_column(df.drop("continent"))
    assert [r["region"] for r in zones.collect()] == ["America", "Asia", "Europe", "Unknown"]


def test_candidates_in_order(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "temperature double, temp_c double")
    assert src.get_temperature_column(df) == "temp_c"
    with pytest.raises(ValueError, match="precipitation"):
        src.get_precipitation_column(df)


def test_parquet_creates_parents_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(20.5, 50), (21.0, 60)], "temperature_celsius double, humidity long")
    path = src.write_parquet(df, tmp_path / "deep" / "er" / "x.parquet")
    assert sorted(map(tuple, src.read_parquet(spark, path).collect())) == [(20.5, 50), (21.0, 60)]


def test_versions(spark, tmp_path):
    params = spark.createDataFrame([("a", 1.0)], "feature string, v double")
    for version in ("20260101T000000Z", "20260201T000000Z"):
        registry.save_artifact(spark, params, {"rmse": 1}, models_dir=str(tmp_path), name="m", version=version)
    assert registry.list_versions(spark, str(tmp_path), "m") == ["20260101T000000Z", "20260201T000000Z"]
    model, meta = registry.load_artifact(spark, str(tmp_path), "m")
    assert meta["version"] == "20260201T000000Z" and meta["rmse"] == 1 and model.first()["feature"] == "a"
    assert registry.list_versions(spark, str(tmp_path), "none") == []
    with pytest.raises(FileNotFoundError):
        registry.latest_version(spark, str(tmp_path), "none")
    with pytest.raises(FileNotFoundError):
        registry.load_artifact(spark, str(tmp_path), "m", version="0")


def test_ml_model_artifact(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(5).selectExpr("double(id) x", "2.0 * id label"))
    registry.save_artifact(spark, LinearRegression().fit(rows), {}, models_dir=str(tmp_path), name="lin")
    model, _ = registry.load_artifact(spark, str(tmp_path), "lin")
    assert abs(model.coefficients[0] - 2) < 1e-6


def test_run_log_appends(spark, tmp_path):
    metrics = spark.createDataFrame([("arima.rmse_c", 1.5), ("sarima.mae_c", 2.0)], "metric string, value double")
    for run in ("a", "b"):
        registry.log_training_run(spark, {"seed": 42}, metrics, log_dir=str(tmp_path / "log"), run_id=run)
    rows = registry.read_runs(spark, str(tmp_path / "log")).collect()
    assert len(rows) == 6 and {r["key"] for r in rows if r["run_id"] == "a"} == {"seed", "arima.rmse_c", "sarima.mae_c"}


def test_synthetic_series(spark):
    rows = synthetic.synthetic_series(spark, 3).orderBy("ds").collect()
    assert rows[0]["ds"] == dt.date(2024, 1, 1) and rows[0]["y"] == 16.03


def test_config():
    assert Config.from_dict({"seed": 7}).seed == 7
    with pytest.raises(ValueError, match="nonsense"):
        Config.from_dict({"nonsense": 1})


def test_names_without_prefix(spark):
    from obsflow.operators import joins

    df = spark.createDataFrame([("air_quality_pm", "air_quality_o3"), ("wind", None)], "x string, y string")
    got = [tuple(r) for r in joins.renamed(joins.without_part(df, ["x", "y"], "air_quality_"), {"x": "driver"}).collect()]
    assert got == [("pm", "o3"), ("wind", None)]
    for names in ({"z": "a"}, {"x": "y"}):
        with pytest.raises(ValueError, match="rename|twice"):
            joins.renamed(df, names)
