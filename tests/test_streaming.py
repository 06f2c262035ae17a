import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from obsflow.operators.series import daily_mean
from obsflow.plans.anomalies import fixed_model
from obsflow.sources import registry
from obsflow.streaming import jobs


def test_stream_equals_batch(spark, folder, tmp_path):
    stream = jobs.file_stream(spark, folder, "events.parquet")
    events = spark.read.parquet(f"{folder}/events.parquet")
    live = jobs.run_available(jobs.daily_mean(stream, "ts", "value"), mode="complete", folder=str(tmp_path))
    batch = daily_mean(events, "ts", "value")
    a = {r["ds"]: r["y"] for r in live.collect()}
    b = {r["ds"]: r["y"] for r in batch.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_folder_tables_are_streamed_whole(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "events.parquet")
    assert jobs.run_available(stream, mode="append", folder=str(tmp_path / "out")).count() == events.count()


def test_append_mode_emits_closed_days_only(spark, folder, tmp_path):
    stream = jobs.file_stream(spark, folder, "events.parquet")
    live = jobs.run_available(jobs.daily_mean(stream, "ts", "value"), mode="append", folder=str(tmp_path))
    events = spark.read.parquet(f"{folder}/events.parquet")
    batch = {r["ds"]: r["y"] for r in daily_mean(events, "ts", "value").collect()}
    closed = {r["ds"]: r["y"] for r in live.collect()}
    assert 0 < len(closed) < len(batch) and all(abs(batch[k] - v) < 1e-9 for k, v in closed.items())


def test_scoring_a_stream_equals_scoring_a_table(spark, folder, tmp_path):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    stream = jobs.file_stream(spark, folder, "lineitem.parquet").select(*cols)
    live = jobs.run_available(jobs.score_stream(stream, fixed_model(), temperature="l_quantity"), mode="append", folder=str(tmp_path))
    table = fixed_model().verdicts(spark.read.parquet(f"{folder}/lineitem.parquet").select(*cols), temperature="l_quantity")
    assert sorted(live.select("if_score", "z").collect()) == sorted(table.select("if_score", "z").collect())


def detect(spark, rows, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(rows, "id long, a double, b double").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("id long, a double, b double").parquet(str(source))
    out = tmp_path / "out"
    jobs.detect_in_batches(stream, ["a", "b"], value="a", id_cols=["id"], folder=str(out), n_trees=20).awaitTermination()
    return out


def test_batch_is_judged_relative_to_itself(spark, tmp_path):
    rows = [(i, 20.0 + i % 5, 50.0 + i % 7) for i in range(30)] + [(30, 60.0, 90.0)]
    out = detect(spark, rows, tmp_path)
    got = {r["id"]: r for r in spark.read.parquet(f"{out}/results").collect()}
    assert len(got) == 31 and got[30]["anomaly_zscore"] and not got[3]["anomaly_zscore"]
    assert got[30]["if_score"] == min(r["if_score"] for r in got.values())


def test_small_batch_is_rejected(spark, tmp_path):
    out = detect(spark, [(1, 1.0, 2.0)], tmp_path)
    assert not (out / "results").exists()
    assert spark.read.parquet(f"{out}/rejected").count() == 1


def test_groups_below_the_minimum_are_kept_as_rejected(spark):
    rows = [("big", float(i)) for i in range(12)] + [("small", 1.0)]
    got = jobs.judge_groups(spark.createDataFrame(rows, "g string, v double"), "g", "v", min_batch=10).collect()
    assert {r["status"] for r in got if r["g"] == "big"} == {"scored"}
    small = [r for r in got if r["g"] == "small"]
    assert len(small) == 1 and small[0]["status"] == "rejected" and small[0]["z"] is None


def test_serving(spark):
    forecasts = spark.createDataFrame([("a", i, float(i)) for i in range(1, 6)], "key string, step int, y_hat double")
    requests = spark.createDataFrame(
        [(1, "a", 5), (2, "a", 0), (3, "b", 2), (4, "a", 366), (5, "a", None), (6, "a", 7), (7, None, 1)], "request_id int, key string, horizon int"
    )
    got = jobs.serve_forecasts(requests, forecasts, "v7").collect()
    by_request = {i: sorted((r for r in got if r["request_id"] == i), key=lambda r: r["step"] or 0) for i in range(1, 8)}
    assert [r["y_hat"] for r in by_request[1]] == [1, 2, 3, 4, 5]
    assert [[r["status"] for r in by_request[i]] for i in (2, 3, 4, 5, 7)] == [["rejected"], ["unavailable"], ["rejected"], ["rejected"], ["unavailable"]]
    assert [(r["step"], r["status"], r["y_hat"]) for r in by_request[6]][4:] == [(5, "ok", 5.0), (6, "not stored", None), (7, "not stored", None)]
    assert {r["version"] for r in got} == {"v7"}


def test_a_new_version_serves_the_next_batch(spark, tmp_path):
    schema = "request_id int, key string, horizon int"

    def ask(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.answer_requests(stream, models_dir=str(tmp_path / "models"), name="m", folder=str(tmp_path / "out")).awaitTermination()

    def save(version, y):
        forecasts = spark.createDataFrame([("a", 1, y)], "key string, step int, y_hat double")
        registry.save_artifact(spark, forecasts, {}, models_dir=str(tmp_path / "models"), name="m", version=version)

    ask((1, "a", 1))
    save("20240101", 1.0)
    ask((2, "a", 1), (3, "a", 0))
    save("20240102", 2.0)
    ask((4, "a", 2))
    got = sorted(tuple(r) for r in jobs.read_answers(spark, str(tmp_path / "out")).select("request_id", "status", F.coalesce("y_hat", F.lit(0.0)), F.coalesce("version", F.lit(""))).collect())
    assert got == [
        (1, "unavailable", 0.0, ""), (2, "ok", 1.0, "20240101"), (3, "rejected", 0.0, "20240101"), (4, "not stored", 0.0, "20240102"), (4, "ok", 2.0, "20240102")
    ]


def arrivals(spark, folder, rows, schema, run):
    """The result after the rows came in so many parts; every part is a run that goes on from the one before."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = run(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    return found


T0 = dt.datetime(2024, 1, 10)


def test_late_rows_are_counted_and_days_replaced(spark, tmp_path):
    at = lambda days, hours=1: T0 + dt.timedelta(days=days, hours=hours)
    parts = [
        [("a", at(0), 1.0), ("b", at(0), 5.0), ("a", at(1), 3.0)],
        [("a", at(1, 9), 5.0), ("a", at(0, 7), 3.0), ("a", None, 1.0), ("b", at(9), None)],
        [("a", at(1), 100.0), ("b", at(0), 100.0), ("b", at(8, 3), 2.0), ("a", at(9, 3), 7.0)],
    ]
    run = lambda stream: jobs.run_updates(jobs.daily_mean(stream, "t", "v", key=F.col("k")), keys=["key"], day="ds", folder=str(tmp_path), counted="n")
    found = arrivals(spark, tmp_path, parts, "k string, t timestamp, v double", run)
    got = {(r["key"], (r["ds"] - T0.date()).days): (r["y"], r["n"]) for r in found.collect()}
    assert got == {("a", 0): (2.0, 2), ("b", 0): (5.0, 1), ("a", 1): (4.0, 2), ("b", 8): (2.0, 1), ("b", 9): (None, 0), ("a", 9): (7.0, 1)}
    assert {r["late_rows"] for r in found.collect()} == {2}


def test_a_repeated_batch_leaves_the_table_as_it_is(spark, tmp_path):
    first = spark.createDataFrame([("a", T0.date(), 1.0), ("b", T0.date(), 2.0), ("a", dt.date(2024, 2, 1), 3.0)], "key string, ds date, y double")
    again = spark.createDataFrame([("b", T0.date(), 9.0), ("c", T0.date(), 4.0)], "key string, ds date, y double")
    for batch in (first, again, again):
        jobs.replace_days(batch, str(tmp_path / "t"), ["key"], "ds")
    got = {(r["key"], r["ds"]): r["y"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {("a", T0.date()): 1.0, ("b", T0.date()): 9.0, ("c", T0.date()): 4.0, ("a", dt.date(2024, 2, 1)): 3.0}


def test_state_behind_the_watermark_is_dropped(spark, tmp_path):
    schema, held = "t timestamp, v double", []
    for days in (0, 40, 80):
        rows = [(T0 + dt.timedelta(days=days + d), 1.0) for d in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.daily_mean(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "t", "v")
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "p")).foreachBatch(lambda b, _: b.write.format("noop").mode("overwrite").save())
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert held[-1] <= 3 and held == [held[0]] * 3


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_sessions_against_brute_force(spark, tmp_path, parts):
    rng, hour = random.Random(4), dt.timedelta(hours=1)
    rows = sorted(((rng.choice(["hot", "hot", "a", "b"]), T0 + rng.randrange(600) * hour) for _ in range(400)), key=lambda r: r[1])
    cut = [rows[i * 100 : (i + 1) * 100] for i in range(4)] if parts == 4 else [rows]
    for part in cut:
        rng.shuffle(part)
    cut[-1].append(("a", None))
    run = lambda stream: jobs.run_sessions(stream, "t", "k", gap_seconds=12 * 3600, late="2 hours", folder=str(tmp_path))
    found = arrivals(spark, tmp_path, cut, "k string, t timestamp", run)
    want = set()
    for key in ("hot", "a", "b"):
        session = []
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if session and t - session[-1] >= 12 * hour:
                want.add((key, session[0], session[-1] + 12 * hour, len(session)))
                session = []
            session.append(t)
        want.add((key, session[0], session[-1] + 12 * hour, len(session)))
    got = found.collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    last = max(t for _, t in rows if t is not None)
    assert all(r["closed"] == (r["session_end"] <= last - 2 * hour) for r in got)


def test_sessions_and_sliding_windows(spark):
    t0 = dt.datetime(2024, 1, 10)
    rows = [(t0, 1.0), (t0 + dt.timedelta(hours=1), 3.0), (t0 + dt.timedelta(hours=30), 5.0)]
    df = spark.createDataFrame([("u", *r) for r in rows], "u string, t timestamp_ntz, v double")
    assert sorted(r["n"] for r in jobs.sessions(df, "t", "u").collect()) == [1, 2]
    means = jobs.sliding_mean(df, "t", "v").where(F.col("n") == 3).collect()
    assert {r["y"] for r in means} == {3.0} and len(means) == 6


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_results_keep_their_schema(spark, folder, tmp_path, mode):
    stream = jobs.file_stream(spark, folder, "events.parquet")
    daily = jobs.daily_mean(stream, "ts", "value")
    assert jobs.run_available(daily, mode=mode, folder=str(tmp_path)).columns == ["key", "ds", "y", "n"]
