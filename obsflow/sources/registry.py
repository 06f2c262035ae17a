"""Versioned model artifacts and the run log, both kept as plain tables and folders."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = "name string, version string, model_class string, metadata string"
RUN_SCHEMA = "run_id string, kind string, key string, value string"


def timestamp_version() -> str:
    """Sortable UTC version text."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def save_artifact(
    spark: SparkSession, model, metadata: dict, *, models_dir: str, name: str, version: str | None = None
) -> str:
    """Save a Spark ML model, or a parameter table, with a metadata row; returns the folder."""
    version = version or timestamp_version()
    folder = f"{models_dir}/{name}/{version}"
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(f"{folder}/model")
        kind = "table"
    else:
        model.write().overwrite().save(f"{folder}/model")
        kind = f"{type(model).__module__}.{type(model).__qualname__}"
    text = json.dumps({**metadata, "name": name, "version": version, "spark_version": spark.version}, default=str)
    row = spark.createDataFrame([(name, version, kind, text)], METADATA_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/metadata")
    return folder


def artifact_table(spark: SparkSession, models_dir: str, name: str) -> DataFrame:
    """Metadata rows of all versions of a model; empty if there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{models_dir}/{name}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return spark.createDataFrame([], METADATA_SCHEMA)
    return spark.read.schema(METADATA_SCHEMA).parquet(f"{models_dir}/{name}/*/metadata")


def list_versions(spark: SparkSession, models_dir: str, name: str) -> list[str]:
    return [r["version"] for r in artifact_table(spark, models_dir, name).orderBy("version").collect()]


def latest_versions(artifacts: DataFrame) -> DataFrame:
    """``(name, version)`` of the newest version of every model: the largest version text."""
    return artifacts.groupBy("name").agg(F.max("version").alias("version"))


def latest_version(spark: SparkSession, models_dir: str, name: str) -> str:
    row = latest_versions(artifact_table(spark, models_dir, name)).first()
    if row is None:
        raise FileNotFoundError(f"no versions for model {name!r} under {models_dir}")
    return row["version"]


def load_artifact(spark: SparkSession, models_dir: str, name: str, *, version: str = "latest"):
    """``(model, metadata)`` of a saved version."""
    if version == "latest":
        version = latest_version(spark, models_dir, name)
    row = artifact_table(spark, models_dir, name).where(F.col("version") == version).first()
    if row is None:
        raise FileNotFoundError(f"no artifact {name!r} version {version!r} under {models_dir}")
    path = f"{models_dir}/{name}/{version}/model"
    if row["model_class"] == "table":
        return spark.read.parquet(path), json.loads(row["metadata"])
    module, _, cls = row["model_class"].rpartition(".")
    loader = getattr(__import__(module, fromlist=[cls]), cls)
    return loader.load(path), json.loads(row["metadata"])


def run_rows(spark: SparkSession, run_id: str, params: dict, metrics: DataFrame) -> DataFrame:
    """``(run_id, kind, key, value)``: parameters, and metrics flattened to ``<model>.<measure>``.

    ``metrics`` has ``metric`` and ``value``.
    """
    settings = spark.createDataFrame([(run_id, "param", k, str(v)) for k, v in params.items()], RUN_SCHEMA)
    measured = metrics.select(
        F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"),
        F.col("metric").alias("key"), F.col("value").cast("string").alias("value"),
    )
    return settings.unionByName(measured)


def log_training_run(
    spark: SparkSession, params: dict, metrics: DataFrame, *, log_dir: str, run_id: str | None = None
) -> str:
    """Append a run to the log table and return its id."""
    run_id = run_id or timestamp_version()
    run_rows(spark, run_id, params, metrics).coalesce(1).write.mode("append").parquet(log_dir)
    return run_id


def read_runs(spark: SparkSession, log_dir: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(log_dir)
