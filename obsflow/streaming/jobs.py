"""Structured Streaming jobs: scoring, batch-relative detection, serving, running means."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from obsflow.functions.scalar import number
from obsflow.operators.anomaly import AnomalyModel, isolation_forest, zscore_anomalies
from obsflow.session import broadcast_if_small, checkpoint_folder, checkpointed
from obsflow.sources import registry

# Fixed limits of the serving contract.
MIN_BATCH = 10
MIN_HORIZON, MAX_HORIZON = 1, 365


def file_stream(spark: SparkSession, folder: str, name: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet table ``name`` of a folder, be it one file or a folder of parts.

    The path is given as a pattern, since the stream reader takes a plain path for a folder. ``files_per_batch`` bounds a micro-batch.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Zone-free times as timestamps, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(stream: DataFrame, *, mode: str, folder: str | None = None) -> DataFrame:
    """Process what is there, stop, and return the stored result.

    Result and progress are kept in the shared checkpoint folder. In complete mode every batch
    replaces the result table.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{folder}/result"
    stream_writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    if mode == "complete":
        stream_writer = stream_writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    else:
        stream_writer = stream_writer.format("parquet").option("path", target)
    stream_writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


class _Seen(StreamingQueryListener):
    """Rows that a query has observed, by micro-batch (a repeated batch counts once)."""

    def __init__(self, name: str):
        self.name, self.rows = name, {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows[event.progress.batchId] = seen["rows"] or 0


def replace_days(batch: DataFrame, target: str, keys: Sequence[str], day: str) -> None:
    """Rows of ``batch`` in place of those with the same keys in the table ``target``, which is partitioned by ``day``.

    Only the days that the batch touches are read and written again. The rows are totals and not changes, so a repeated batch leaves the same table.
    """
    spark = batch.sparkSession
    fresh = checkpointed(batch)
    if fresh.isEmpty():
        return
    try:
        stored = spark.read.schema(batch.schema).parquet(target)
    except AnalysisException:  # nothing is stored yet
        stored = fresh.limit(0)
    days = fresh.select(day).distinct()
    kept = stored.join(broadcast_if_small(days), day, "left_semi").join(fresh.select(*keys, day), [*keys, day], "left_anti")
    merged = checkpointed(kept.unionByName(fresh))  # read in full before its days are overwritten
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)


def run_updates(stream: DataFrame, *, keys: Sequence[str], day: str, folder: str, counted: str | None = None) -> DataFrame:
    """Process what is there in update mode and return the table as it then stands.

    Every batch replaces its rows in the days it touches; the rest of the table is neither read nor written. Called again with the same
    ``folder``, it goes on where it stopped. With ``counted`` (the result column that counts rows; the stream observes ``rows`` under the name ``seen``)
    the rows that came later than the watermark allows, in all runs so far, stand in ``late_rows``.
    """
    spark = stream.sparkSession
    target, runs = f"{folder}/result", f"{folder}/runs"

    def total() -> int:
        try:
            return spark.read.schema(stream.schema).parquet(target).agg(F.sum(counted)).first()[0] or 0
        except AnalysisException:
            return 0

    before = total() if counted else 0
    seen = _Seen("seen")
    spark.streams.addListener(seen)
    try:
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
        query = writer.foreachBatch(lambda batch, _: replace_days(batch, target, keys, day)).trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:  # the listener may lag behind
            if (row := progress.observedMetrics.get("seen")) is not None:
                seen.rows[progress.batchId] = row["rows"] or 0
    finally:
        spark.streams.removeListener(seen)
    result = spark.read.schema(stream.schema).parquet(target)
    if not counted:
        return result
    late = sum(seen.rows.values()) - (total() - before)
    spark.createDataFrame([(late,)], "late_rows long").coalesce(1).write.mode("append").parquet(runs)
    everything = spark.read.schema("late_rows long").parquet(runs).agg(F.sum("late_rows").alias("n"))
    return result.withColumn("late_rows", everything.scalar())


def daily_mean(events: DataFrame, ts: str, value: str, *, key: Column | None = None, late: str = "1 day") -> DataFrame:
    """Running daily mean: ``(key, ds, y, n)``; state older than the watermark is dropped.

    A stream observes its known values as ``rows`` under the name ``seen``.
    """
    keyed = event_time(events, ts).select(
        (F.lit("global") if key is None else key).alias("key"), F.col(ts).alias("t"), number(value).alias("v")
    )
    if events.isStreaming:
        keyed = keyed.where(F.col("t").isNotNull()).observe("seen", F.count("v").alias("rows"))
    days = keyed.withWatermark("t", late).groupBy(F.window("t", "1 day").alias("w"), "key")
    return days.agg(F.avg("v").alias("y"), F.count("v").alias("n")).select(
        "key", F.to_date("w.start").alias("ds"), "y", "n"
    )


def sliding_mean(events: DataFrame, ts: str, value: str, *, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean over sliding windows: ``(window_start, y, n)``. Works on tables and streams."""
    timed = event_time(events, ts).select(F.col(ts).alias("t"), number(value).alias("v"))
    windows = timed.withWatermark("t", late).groupBy(F.window("t", length, step).alias("w"))
    return windows.agg(F.avg("v").alias("y"), F.count("v").alias("n")).select(
        F.col("w.start").alias("window_start"), "y", "n"
    )


def sessions(events: DataFrame, ts: str, key: str, *, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a key that end after a gap: ``(key, session_start, session_end, n)``.

    For streams; a table whose keys may hold a large share of the rows is cut by
    ``series.sessionize`` instead.
    """
    timed = event_time(events, ts).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


SESSION_FIELDS = "first long, last long, n long"


class SessionState(StatefulProcessor):
    """Sessions of a key that can still change, and a timer for the first of them to end.

    Rows of a key come as a stream of chunks, each of which shrinks to its runs, so what is held is the number of open sessions. When a key changes,
    all its open sessions are given out with the closed ones.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SESSION_FIELDS)

    def runs(self, parts: np.ndarray) -> np.ndarray:
        """Rows (first, last, n) put together where there is less than a gap between them."""
        parts = parts[np.argsort(parts[:, 0], kind="stable")]
        reach = np.maximum.accumulate(parts[:, 1])
        starts = np.flatnonzero(np.concatenate([[True], parts[1:, 0] - reach[:-1] >= self.gap]))
        ends = np.append(starts[1:], len(parts)) - 1
        return np.stack([parts[starts, 0], reach[ends], np.add.reduceat(parts[:, 2], starts)], axis=1)

    def settle(self, key: tuple, sessions: np.ndarray, now_ms: int) -> Iterator[pd.DataFrame]:
        """Give all sessions out, keep the open ones and set the timer."""
        closed = sessions[:, 1] + self.gap <= now_ms * 1000
        left = sessions[~closed]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            self.open.put([tuple(int(x) for x in row) for row in left])
            self.handle.registerTimer(int(left[:, 1].min() + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        yield pd.DataFrame({"key": [key[0]] * len(sessions), "first": sessions[:, 0], "last": sessions[:, 1], "n": sessions[:, 2], "closed": closed})

    def held(self) -> np.ndarray:
        return np.array([tuple(r) for r in self.open.get()] if self.open.exists() else [], np.int64).reshape(-1, 3)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions = self.held()
        for chunk in rows:
            at = chunk["at"].to_numpy(np.int64)
            sessions = self.runs(np.concatenate([sessions, np.stack([at, at, np.ones_like(at)], axis=1)]))
        if len(sessions):
            yield from self.settle(key, sessions, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self.held()
        if len(sessions):
            yield from self.settle(key, sessions, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_updates(events: DataFrame, ts: str, key: str, *, gap_seconds: float, late: str = "1 day") -> DataFrame:
    """Changes of sessions: ``key, first, last, n, closed`` (times in microseconds), for :func:`run_sessions`."""
    timed = event_time(events, ts).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = timed.select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"))
    schema = f"key {events.schema[key].dataType.simpleString()}, {SESSION_FIELDS}, closed boolean"
    return rows.groupBy("key").transformWithStateInPandas(SessionState(int(gap_seconds * 1e6)), schema, "Update", "EventTime")


def run_sessions(events: DataFrame, ts: str, key: str, *, gap_seconds: float, late: str = "1 day", folder: str | None = None) -> DataFrame:
    """Sessions of what has come so far: ``(key, session_start, session_end, n, closed)``; open ones may still grow.

    Every batch is written under its number, so a repeated one replaces itself. A key gives out all its open sessions whenever it changes, so the
    result is every closed session, and the open ones of each key's last batch. Called again with the same ``folder``, it goes on.
    """
    spark = events.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{folder}/changes"
    changes = session_updates(events, ts, key, gap_seconds=gap_seconds, late=late)

    def write(batch: DataFrame, number_: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number_}")

    known = spark.conf.get(*ROCKSDB[:1], None)
    spark.conf.set(*ROCKSDB)  # the query takes its settings over when it starts
    try:
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
        query = writer.foreachBatch(write).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(ROCKSDB[0]) if known is None else spark.conf.set(ROCKSDB[0], known)
    query.awaitTermination()
    rows = spark.read.schema(f"{changes.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(target)
    last = rows.groupBy("key").agg(F.max("batch").alias("_last"))
    alive = rows.where("not closed").join(last, "key").where("batch = _last").drop("_last")
    both = rows.where("closed").unionByName(alive)
    end = F.timestamp_micros(F.col("last") + F.lit(int(gap_seconds * 1e6)))
    return both.select(F.col("key").alias(key), F.timestamp_micros("first").alias("session_start"), end.alias("session_end"), "n", "closed")


def score_stream(events: DataFrame, model: AnomalyModel, *, temperature: str) -> DataFrame:
    """Verdicts of a stored model on arriving rows; no state."""
    return model.verdicts(events, temperature=temperature)


def detect_in_batches(
    stream: DataFrame, features: Sequence[str], *, value: str, id_cols: Sequence[str], folder: str, min_batch: int = MIN_BATCH,
    **forest_settings,
):
    """Started query that judges each micro-batch relative to itself.

    Results go to ``folder/results``, batches that are too small to judge to ``folder/rejected``. Both
    are written per batch number, so a repeated batch replaces its own rows.
    """

    def judge(batch: DataFrame, number_: int) -> None:
        rows = checkpointed(batch)
        if rows.limit(min_batch).count() < min_batch:
            rows.write.mode("overwrite").parquet(f"{folder}/rejected/batch={number_}")
            return
        flagged, _ = isolation_forest(rows, features, value=value, id_cols=id_cols, **forest_settings)
        judged = zscore_anomalies(flagged, value)
        judged.write.mode("overwrite").parquet(f"{folder}/results/batch={number_}")

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(availableNow=True).start()


def judge_groups(df: DataFrame, group: str, value: str, *, min_batch: int = MIN_BATCH, threshold: float = 3.0) -> DataFrame:
    """Batch-relative z-scores of a table whose batches are named by a column.

    Adds ``status``: rows of batches below the minimum are kept as ``rejected``, without verdict.
    """
    scored = zscore_anomalies(df, value, threshold=threshold, by=[group])
    sizes = df.groupBy(group).agg(F.count("*").alias("batch_rows"))
    small = sizes.where(F.col("batch_rows") < min_batch).select(group, F.lit(True).alias("small"))
    joined = scored.join(broadcast_if_small(small), group, "left")
    rejected = F.coalesce("small", F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(rejected, "rejected").otherwise("scored"),
            "z": F.when(~rejected, F.col("z")),
            "anomaly_zscore": F.when(~rejected, F.col("anomaly_zscore")),
        }
    ).drop("small")


def serve_forecasts(requests: DataFrame, forecasts: DataFrame, version: Column | str | None = None) -> DataFrame:
    """Answers to ``(request_id, key, horizon)`` rows from a table ``(key, step, y_hat)``.

    A horizon outside 1..365 is answered ``rejected``, a key without forecasts ``unavailable``, with one row each; all other requests get one
    row per step: ``ok``, or ``not stored`` where the forecasts end before it. ``version`` names the forecasts in the column of that name.
    """
    checked = requests.withColumn("valid", F.coalesce(F.col("horizon").between(MIN_HORIZON, MAX_HORIZON), F.lit(False)))
    keys = broadcast_if_small(forecasts.select("key").distinct().withColumn("known", F.lit(True)))
    checked = checked.join(keys, "key", "left").withColumn("served", F.col("valid") & F.coalesce("known", F.lit(False)))
    steps = F.explode(F.when(F.col("served"), F.sequence(F.lit(1), F.col("horizon"))).otherwise(F.array(F.lit(None).cast("int"))))
    answers = checked.withColumn("step", steps).join(forecasts.select("key", "step", "y_hat"), ["key", "step"], "left")
    status = (
        F.when(~F.col("valid"), "rejected").when(~F.col("served"), "unavailable").when(F.col("y_hat").isNull(), "not stored").otherwise("ok")
    )
    columns = ["request_id", "key", "horizon", status.alias("status"), "step", "y_hat"]
    if version is not None:
        columns.append((F.lit(version) if isinstance(version, str) else version).alias("version"))
    return answers.select(*columns)


def answer_requests(requests: DataFrame, *, models_dir: str, name: str, folder: str) -> StreamingQuery:
    """Started query that answers each micro-batch of requests from the newest stored forecasts.

    The version is looked up when a batch begins, so a version that is saved later serves the batches after it. Answers go to
    ``folder/answers`` under the batch's number; a repeated batch replaces its own. Without a stored version all requests are ``unavailable``.
    """
    spark = requests.sparkSession
    nothing = "key string, step int, y_hat double"

    def answer(batch: DataFrame, number_: int) -> None:
        newest = registry.latest_versions(registry.artifact_table(spark, models_dir, name)).first()
        if newest is None:
            forecasts, version = spark.createDataFrame([], nothing), F.lit(None).cast("string")
        else:
            version = newest["version"]
            forecasts, _ = registry.load_artifact(spark, models_dir, name, version=version)
        serve_forecasts(batch, forecasts, version).write.mode("overwrite").parquet(f"{folder}/answers/batch={number_}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(availableNow=True).start()


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """All answers, with the ``batch`` that gave them."""
    return spark.read.parquet(f"{folder}/answers")
