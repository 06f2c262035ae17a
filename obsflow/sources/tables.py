"""Reading and checking observation tables; writing and reading Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsflow.functions.scalar import region

# Fixed names: required columns and the ordered spellings of drifting ones.
REQUIRED = ["last_updated", "temperature_celsius"]
TEMPERATURE = ["temperature_celsius", "temp_c", "temperature"]
PRECIPITATION = ["precip_mm", "precipitation_mm", "precipitation", "precip_in"]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The table as it is, or an error that names every missing column; starts no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def parse_timestamps(df: DataFrame, ts: str) -> DataFrame:
    """``ts`` as timestamp; rows whose text cannot be parsed are dropped."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts)))
    return df.where(F.col(ts).isNotNull())


def read_csv(spark: SparkSession, path: str | Path, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; types are inferred unless a schema is given (which saves a pass)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        return reader.csv(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"raw data not found: {path}") from error
        raise


def load_observations(
    spark: SparkSession, path: str | Path, *, required: Sequence[str] = REQUIRED, ts: str = REQUIRED[0],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Checked observations, ascending by time."""
    raw = require_columns(read_csv(spark, path, schema), required)
    return parse_timestamps(raw, ts).orderBy(ts)


def get_column_or_raise(df: DataFrame, candidates: Sequence[str], description: str) -> str:
    """The first candidate the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no {description} column found, tried: {list(candidates)}")


def get_temperature_column(df: DataFrame) -> str:
    return get_column_or_raise(df, TEMPERATURE, "temperature")


def get_precipitation_column(df: DataFrame) -> str:
    return get_column_or_raise(df, PRECIPITATION, "precipitation")


def add_region_column(df: DataFrame, *, continent: str = "continent", zone: str = "timezone") -> DataFrame:
    """Adds ``region``; either source column may be absent."""

    def known(c: str) -> Column | None:
        return F.col(c) if c in df.columns else None

    return df.withColumn("region", region(known(continent), known(zone)))


def write_parquet(df: DataFrame, path: str | Path, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write and return the path; missing parent folders are created. A table has no index to keep."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(str(path))
    return str(path)


def read_parquet(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.read.parquet(str(path))
