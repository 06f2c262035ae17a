"""Published sections, model versions and run logs on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.functions import scalar
from obsflow.operators import anomaly, evaluate, explain, search
from obsflow.operators import series as ops
from obsflow.plans.anomalies import ANOMALY_PARAMS_SQL, FLAGS, IDS, PARAMS, RECORDS_SQL, flagged_events, flags, holed_lines
from obsflow.plans.catalog import Tables, query, r6
from obsflow.plans.series import BASE, DAILY, ENSEMBLES, naive_run, orders_daily
from obsflow.session import checkpoint_folder, checkpointed
from obsflow.sources import contract, registry, synthetic

STAMP = "2024-01-01T00:00:00Z"


def scratch(t: Tables) -> str:
    return f"{checkpoint_folder(t.spark)}/published-{uuid.uuid4().hex}"


def forecast_section(t: Tables) -> DataFrame:
    daily = orders_daily(t)
    split = ops.split_tail(daily, test=30)
    predictions = naive_run(t)["predictions"]
    return contract.build_forecast(
        ops.last_rows(split.where("split = 'train'"), 90), split.where("split = 'test'"), predictions,
        generated_at=STAMP, names={"ensemble_weighted": "Ensemble (weighted)", "lag_1": "Yesterday"},
    )


def metrics_section(t: Tables) -> DataFrame:
    rows = naive_run(t)["metrics"].withColumn("name", F.initcap(F.replace("model_id", F.lit("_"), F.lit(" "))))
    return contract.build_metrics(rows, generated_at=STAMP, caveats=["naive models"])


FORECAST_SQL = (
    BASE
    + ENSEMBLES
    + """, p AS (SELECT ds, model_id, y_hat FROM preds JOIN split USING (ds) WHERE split = 'test' UNION ALL SELECT ds, model_id, y_hat FROM ens),
  pts AS (SELECT 'actual' AS series, ds, y AS v FROM split WHERE back <= 30 UNION ALL SELECT 'history', ds, y FROM split WHERE back BETWEEN 31 AND 120
    UNION ALL SELECT model_id, ds, y_hat FROM p)
  SELECT series, count(*) AS points, strftime(min(ds), '%Y-%m-%d') AS first_date, strftime(max(ds), '%Y-%m-%d') AS last_date, round(avg(v), 1) AS mean FROM pts GROUP BY 1"""
)


@query("contract_forecast", FORECAST_SQL)
def contract_forecast(t: Tables):
    section = contract.validate("forecast", forecast_section(t))
    series = section.select("series.*")
    lines = F.concat(
        F.array(
            F.struct(F.lit("history").alias("series"), F.col("history").alias("pts")),
            F.struct(F.lit("actual").alias("series"), F.col("actual").alias("pts")),
        ),
        F.transform("models", lambda m: F.struct(m["id"].alias("series"), m["predictions"].alias("pts"))),
    )
    points = series.select(F.inline(lines)).select("series", F.inline("pts"))
    return points.groupBy("series").agg(
        F.count("*").alias("points"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        r6(F.avg("value"), "mean", 1),
    )


METRICS_SQL = (
    BASE
    + ENSEMBLES
    + """ SELECT model_id AS id, round(rmse_c, 5) AS rmse_c, round(mae_c, 5) AS mae_c, round(mape_pct, 5) AS mape_pct, round(weight, 6) AS ensemble_weight,
    'final' AS status FROM everything LEFT JOIN weights USING (model_id)"""
)


def metrics_rows(section: DataFrame) -> DataFrame:
    return section.select(F.inline("models")).select(
        "id", *[r6(c, digits=5) for c in ("rmse_c", "mae_c", "mape_pct")], r6("ensemble_weight"), "status"
    )


@query("contract_metrics", METRICS_SQL)
def contract_metrics(t: Tables):
    return metrics_rows(contract.validate("metrics", metrics_section(t)))


@query("contract_roundtrip", METRICS_SQL)
def contract_roundtrip(t: Tables):
    folder = scratch(t)
    contract.write_section(metrics_section(t), folder, "metrics")
    return metrics_rows(contract.read_section(t.spark, folder, "metrics"))


@query(
    "contract_anomalies",
    f"""WITH r AS ({RECORDS_SQL.strip()}),
    picked AS (SELECT * FROM r ORDER BY (CAST(lon AS BIGINT) + 42) % 2147483648 * 2654435761 % 4294967296, lon LIMIT 150),
    {FLAGS}, m AS (SELECT count(*) FILTER (WHERE a) AS z_count, count(*) FILTER (WHERE b) AS if_count, count(*) FILTER (WHERE a AND b) AS overlap_count FROM flags)
    SELECT picked.ts, country, lat, lon, temp_c, detected_by, z_count, if_count, overlap_count FROM picked, m""",
)
def contract_anomalies(t: Tables):
    summary = anomaly.method_summary(flags(t), threshold=1.5, contamination=0.02, a="a", b="b")
    section = contract.validate("anomalies", contract.build_anomalies(summary, sampled_records(t), generated_at=STAMP))
    flat = section.select(
        F.inline("records"), F.col("methods.zscore.count").alias("z_count"),
        F.col("methods.isolation_forest.count").alias("if_count"), F.col("methods.overlap_count").alias("overlap_count"),
    )
    return flat.select("ts", "country", "lat", "lon", "temp_c", "detected_by", "z_count", "if_count", "overlap_count")


def sampled_records(t: Tables) -> DataFrame:
    """The 150 records that are published."""
    records = anomaly.anomaly_records(
        flagged_events(t), ts="ts", country=F.col("event_type"), lat=F.col("user_id").cast("double"),
        lon=F.col("event_id").cast("double"), temp=F.col("value"),
    )
    return anomaly.hash_sample(records, 150, F.col("lon").cast("long"))


EXAMPLE_QUERIES = ["errors with a very high value", "unusual clicks", "a severe anomaly detected by both"]


@query(
    "contract_embeddings",
    f"""WITH r AS ({RECORDS_SQL.strip()}),
    picked AS (SELECT * FROM r ORDER BY (CAST(lon AS BIGINT) + 42) % 2147483648 * 2654435761 % 4294967296, lon LIMIT 150)
    SELECT 'record' AS kind, country || ' ' || ts AS text, detected_by, 384 AS dim, 1.0::DOUBLE AS length FROM picked
    UNION ALL SELECT 'query', unnest([{", ".join(f"'{q}'" for q in EXAMPLE_QUERIES)}]), NULL, 384, 1.0""",
)
def contract_embeddings(t: Tables):
    texts = sampled_records(t).withColumn("text", scalar.render_record(F.col("ts"), F.col("country"), F.col("temp_c"), F.col("z"), F.col("detected_by")))
    texts = checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))
    asked = t.spark.createDataFrame([(i, q) for i, q in enumerate(EXAMPLE_QUERIES)], "id long, text string")
    embed = search.fit_text_embedder(texts.select("text").union(asked.select("text")))
    records, queries = search.SemanticIndex(texts, embed, id_col="id", text="text").payload(asked)
    folder = scratch(t)
    contract.write_section(contract.build_embeddings(records, queries, model="hashed-tfidf-384"), folder, "embeddings")
    section = contract.read_section(t.spark, folder, "embeddings")
    length = F.bround(scalar.norm(F.col("embedding")), 3).alias("length")
    rows = section.select("dim", F.inline("records")).select(
        F.lit("record").alias("kind"), F.concat_ws(" ", "country", "ts").alias("text"), "detected_by", "dim", length
    )
    nobody = F.lit(None).cast("string").alias("detected_by")
    return rows.union(section.select("dim", F.inline("queries")).select(F.lit("query").alias("kind"), "text", nobody, "dim", length))


@query("contract_model", ANOMALY_PARAMS_SQL.replace("AS max_samples FROM", "AS max_samples, CAST(200 AS INTEGER) AS trees, CAST(51200 AS BIGINT) AS root_rows FROM"))
def contract_model(t: Tables):
    _, model = anomaly.isolation_forest(holed_lines(t), PARAMS, id_cols=IDS)
    folder = scratch(t)
    contract.write_section(contract.build_model(t.spark, model, generated_at=STAMP), folder, "model")
    section = contract.read_section(t.spark, folder, "model")
    forest = F.col("isolation_forest")
    roots = F.aggregate(forest["trees"], F.lit(0).cast("long"), lambda n, tree: n + tree["n_node_samples"][0])
    columns = F.arrays_zip(
        F.col("features").alias("feature"), F.col("medians").alias("median"), F.col("scaler.mean").alias("mean"), F.col("scaler.scale").alias("scale"),
        F.col("feature_ranges.min").alias("min"), F.col("feature_ranges.max").alias("max"),
    )
    table = section.select(
        F.inline(columns), F.col("zscore.mu").alias("mu"), F.col("zscore.sigma").alias("sigma"), F.col("zscore.threshold").alias("threshold"),
        forest["max_samples"].alias("max_samples"), F.size(forest["trees"]).alias("trees"), roots.alias("root_rows"),
    )
    digits = {"median": 6, "mean": 7, "scale": 5, "mu": 6, "sigma": 6}
    return table.select("feature", *[r6(c, digits=d) for c, d in digits.items()], "min", "max", "threshold", "max_samples", "trees", "root_rows")


@query("contract_shap")
def contract_shap(t: Tables):
    from obsflow.plans.forecasting import explained_sample

    points = checkpointed(explained_sample(t))
    section = contract.build_shap(
        explain.mean_abs_shap(points), points, generated_at=STAMP, sample_n=1000,
        order=F.struct("l_orderkey", "l_linenumber", "l_partkey"), model="gbt", target="l_extendedprice",
    )
    return contract.validate("shap", section, {"target": ["l_extendedprice"]}).select(F.inline("features"), "sample_n", F.size("beeswarm").alias("swarms"))


@query(
    "latest_version",
    "SELECT event_type AS name, max(strftime(ts, '%Y%m%dT%H%M%SZ')) AS version FROM events GROUP BY 1",
)
def latest_version(t: Tables):
    artifacts = t.events.select(F.col("event_type").alias("name"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("version"))
    return registry.latest_versions(artifacts)


@query(
    "run_log_flatten",
    BASE
    + " SELECT model_id || '.rmse_c' AS metric, round(rmse_c, 5) AS value FROM metrics WHERE split = 'test'"
    + " UNION ALL SELECT model_id || '.mae_c', round(mae_c, 5) FROM metrics WHERE split = 'test'"
    + " UNION ALL SELECT model_id || '.mape_pct', round(mape_pct, 5) FROM metrics WHERE split = 'test'",
)
def run_log_flatten(t: Tables):
    from obsflow.plans.series import naive_metrics

    flat = evaluate.flattened_metrics(naive_metrics(t, "test"))
    folder = scratch(t)
    registry.log_training_run(t.spark, {"seed": 42, "test_window_days": 30}, flat.drop("key"), log_dir=folder, run_id="run")
    runs = registry.read_runs(t.spark, folder).where("kind = 'metric'")
    return runs.select(F.col("key").alias("metric"), r6(F.col("value").cast("double"), "value", 5))


@query(
    "synthetic_series",
    f"""WITH {DAILY}, i AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS i FROM daily)
    SELECT ds, round(16.03 + 6 * sin(2 * pi() * i / 365.0) + 0.6 * sin(i / 3.0), 6) AS y FROM i""",
)
def synthetic_series(t: Tables):
    # The formula laid on the days of the orders table, one position per day.
    numbered = orders_daily(t).select("ds", (F.row_number().over(ops.per_key()) - 1).alias("i"))
    return numbered.select("ds", r6(synthetic.series_value(F.col("i")), "y"))
