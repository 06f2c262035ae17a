"""Streaming jobs on the test tables; every stream runs to the end of what is there and stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsflow.operators import forecast
from obsflow.operators import series as ops
from obsflow.plans.anomalies import fixed_model
from obsflow.plans.catalog import Tables, query, r6
from obsflow.plans.profiling import scratch
from obsflow.session import checkpointed
from obsflow.sources import registry
from obsflow.streaming import jobs


@query(
    "batch_relative_zscore",
    """
    WITH e AS (SELECT event_id, value, CAST(ts AS DATE) AS day FROM events),
    s AS (SELECT day, avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sigma, count(*) AS n FROM e GROUP BY 1)
    SELECT event_id, day, CASE WHEN n < 330 THEN 'rejected' ELSE 'scored' END AS status,
           CASE WHEN n >= 330 THEN round((value - mu) / sigma, 6) END AS z, CASE WHEN n >= 330 THEN abs((value - mu) / sigma) > 3 END AS anomaly_zscore
    FROM e JOIN s USING (day)
    """,
)
def batch_relative_zscore(t: Tables):
    events = t.events.select("event_id", "value", F.to_date("ts").alias("day"))
    judged = jobs.judge_groups(events, "day", "value", min_batch=330)
    return judged.select("event_id", "day", "status", r6("z"), "anomaly_zscore")


@query("micro_batch_detection")
def micro_batch_detection(t: Tables):
    folder = scratch(t, "detect")
    stream = jobs.file_stream(t.spark, t.folder, "events.parquet").select(
        "event_id", F.col("value").alias("v"), F.col("user_id").cast("double").alias("u"), F.hour("ts").cast("double").alias("h")
    )
    jobs.detect_in_batches(
        stream, ["v", "u", "h"], value="v", id_cols=["event_id"], folder=folder
    ).awaitTermination()
    return t.spark.read.parquet(f"{folder}/results").select("event_id", "z", "anomaly_zscore", "if_score", "anomaly_if")


@query(
    "score_stream",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - 25.0) / 14.0, 6) AS z, abs((l_quantity - 25.0) / 14.0) > 1.5 AS anomaly_zscore FROM lineitem""",
)
def score_stream(t: Tables):
    stream = jobs.file_stream(t.spark, t.folder, "lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    scored = jobs.run_available(jobs.score_stream(stream, fixed_model(), temperature="l_quantity"), mode="append")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", r6("z"), "anomaly_zscore")


@query(
    "stream_daily_mean",
    "SELECT event_type AS key, CAST(ts AS DATE) AS ds, round(avg(value), 6) AS y, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_daily_mean(t: Tables):
    stream = jobs.file_stream(t.spark, t.folder, "events.parquet")
    daily = jobs.daily_mean(stream, "ts", "value", key=F.col("event_type"))
    return jobs.run_updates(daily, keys=["key"], day="ds", folder=scratch(t, "daily")).select("key", "ds", r6("y"), "n")


@query(
    "stream_late_rows",
    """
    WITH e AS (SELECT event_type, CAST(ts AS DATE) AS ds, value, (event_type = 'error' AND ts < m.middle) AS held
               FROM events, (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events) m),
    open_days AS (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) AS first_open FROM events)
    SELECT event_type AS key, ds, round(avg(value), 6) AS y, count(*) AS n,
           (SELECT count(*) FROM e, open_days WHERE held AND ds < first_open) AS late_rows
    FROM e, open_days WHERE NOT held OR ds >= first_open GROUP BY 1, 2
    """,
)
def stream_late_rows(t: Tables):
    """The events in three arrivals: the first half, the second half, and the errors of the first half, which come too late."""
    folder = scratch(t, "late")
    ends = t.events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")).first()
    early = F.unix_micros(F.col("ts").cast("timestamp")) < ends["a"] + (ends["b"] - ends["a"]) / 2
    held = early & (F.col("event_type") == "error")
    for arrival in (early & ~held, ~early, held):
        t.events.where(arrival).write.mode("append").parquet(f"{folder}/in/events.parquet")
        stream = jobs.file_stream(t.spark, f"{folder}/in", "events.parquet")
        daily = jobs.daily_mean(stream, "ts", "value", key=F.col("event_type"))
        found = jobs.run_updates(daily, keys=["key"], day="ds", folder=folder, counted="n")
    return found.select("key", "ds", r6("y"), "n", "late_rows")


SLIDING = """
WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS s, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT day - CAST(k AS INTEGER) AS start, s, n FROM d, (SELECT unnest(range(0, 7)) AS k))
SELECT CAST(start AS TIMESTAMP) AS window_start, round(sum(s) / sum(n), 6) AS y, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1
"""


@query("sliding_mean", SLIDING)
def sliding_mean(t: Tables):
    means = jobs.sliding_mean(t.events, "ts", "value")
    return means.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), r6("y"), "n")


@query("stream_sliding_mean", SLIDING)
def stream_sliding_mean(t: Tables):
    means = jobs.sliding_mean(jobs.file_stream(t.spark, t.folder, "events.parquet"), "ts", "value")
    daily = means.withColumn("day", F.to_date("window_start"))
    found = jobs.run_updates(daily, keys=["window_start"], day="day", folder=scratch(t, "sliding"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), r6("y"), "n")


SESSIONS = """
WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s
"""


@query("sessions", SESSIONS)
def sessions(t: Tables):
    return ops.sessionize(t.events, "ts", "user_id", gap_seconds=12 * 3600)


@query("stream_sessions", SESSIONS)
def stream_sessions(t: Tables):
    stream = jobs.file_stream(t.spark, t.folder, "events.parquet")
    found = jobs.run_sessions(stream, "ts", "user_id", gap_seconds=12 * 3600, folder=scratch(t, "sessions"))
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")]
    return found.select("user_id", *times, "n")


@query(
    "forecast_requests",
    """
    WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, avg(value) AS y FROM events GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS back FROM d),
    r AS (SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'click' WHEN c_mktsegment = 'MACHINERY' THEN 'nothing' ELSE 'view' END AS key,
            CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE c_nationkey + 1 END AS horizon FROM customer)
    SELECT request_id, r.key, horizon, 'ok' AS status, CAST(h.step AS INTEGER) AS step, round(y, 6) AS y_hat
    FROM r JOIN (SELECT unnest(range(1, 366)) AS step) h ON h.step <= horizon JOIN b ON b.key = r.key AND back <= 7 AND 8 - back = (h.step - 1) % 7 + 1
    WHERE horizon >= 1
    UNION ALL SELECT request_id, key, horizon, CASE WHEN horizon < 1 THEN 'rejected' ELSE 'unavailable' END, NULL, NULL FROM r
    WHERE horizon < 1 OR key = 'nothing'
    """,
)
def forecast_requests(t: Tables):
    panel = ops.daily_mean(t.events, "ts", "value", key="event_type")
    forecasts = checkpointed(forecast.seasonal_naive(panel, jobs.MAX_HORIZON))
    segment = F.col("c_mktsegment")
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.when(segment == "BUILDING", "click").when(segment == "MACHINERY", "nothing").otherwise("view").alias("key"),
        F.when(segment == "HOUSEHOLD", 0).otherwise(F.col("c_nationkey") + 1).alias("horizon"),
    )
    return jobs.serve_forecasts(requests, forecasts).withColumn("y_hat", r6("y_hat"))


@query(
    "forecast_versions",
    """
    WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, avg(value) AS y FROM events GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS back FROM d),
    r AS (SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'nothing' ELSE 'click' END AS key, c_nationkey AS horizon,
                 CASE WHEN c_mktsegment = 'BUILDING' THEN 'v1' ELSE 'v2' END AS version FROM customer),
    s AS (SELECT r.*, unnest(range(1, horizon + 1)) AS step FROM r WHERE horizon >= 1 AND key <> 'nothing')
    SELECT request_id, s.key, horizon, CASE WHEN y IS NULL THEN 'not stored' ELSE 'ok' END AS status, CAST(step AS INTEGER) AS step,
           round(y, 6) AS y_hat, version
    FROM s LEFT JOIN b ON b.key = s.key AND back <= 7 AND 8 - back = (step - 1) % 7 + 1 AND step <= CASE version WHEN 'v1' THEN 10 ELSE 20 END
    UNION ALL SELECT request_id, key, horizon, CASE WHEN horizon < 1 THEN 'rejected' ELSE 'unavailable' END, NULL, NULL, version FROM r
    WHERE horizon < 1 OR key = 'nothing'
    """,
)
def forecast_versions(t: Tables):
    """Requests in two arrivals; between them a second version with more steps is stored."""
    folder = scratch(t, "served")
    panel = ops.daily_mean(t.events, "ts", "value", key="event_type")
    building = F.col("c_mktsegment") == "BUILDING"
    for version, steps, mine in (("v1", 10, building), ("v2", 20, ~building)):
        registry.save_artifact(t.spark, forecast.seasonal_naive(panel, steps), {}, models_dir=f"{folder}/models", name="daily", version=version)
        key = F.when(F.col("c_mktsegment") == "MACHINERY", "nothing").otherwise("click")
        requests = t.customer.where(mine).select(F.col("c_custkey").alias("request_id"), key.alias("key"), F.col("c_nationkey").cast("int").alias("horizon"))
        requests.write.mode("append").parquet(f"{folder}/in/requests.parquet")
        stream = jobs.file_stream(t.spark, f"{folder}/in", "requests.parquet")
        jobs.answer_requests(stream, models_dir=f"{folder}/models", name="daily", folder=folder).awaitTermination()
    return jobs.read_answers(t.spark, folder).select("request_id", "key", "horizon", "status", "step", r6("y_hat"), "version")
