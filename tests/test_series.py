import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.operators import series as ops

T0 = dt.datetime(2024, 1, 1)


def by_day(df, c):
    return [r[c] for r in df.orderBy("ds").select(c).collect()]


def test_daily_mean_skips_nulls_and_nan(spark):
    rows = [
        (dt.datetime(2024, 1, 2, 6), 20.0), (dt.datetime(2024, 1, 2, 18), 22.0), (dt.datetime(2024, 1, 2, 20), float("nan")),
        (dt.datetime(2024, 1, 1, 12), 10.0), (dt.datetime(2024, 1, 3, 12), None),
    ]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    assert by_day(ops.daily_mean(df, "t", "v"), "y") == [10.0, 21.0, None]


def test_features_of_a_ramp(series):
    f = ops.create_features(series(range(60)))
    assert len(f.columns) == 3 + 20 and f.columns[3:] == ops.feature_names()
    assert by_day(f, "lag_7")[:9] == [None] * 7 + [0.0, 1.0]
    means = by_day(f, "rolling_mean_7")
    assert means[:7] == [None] * 7 and means[7] == 3.0
    assert by_day(f, "rolling_std_7")[7] == pytest.approx(np.std(range(7), ddof=1))
    assert by_day(f, "dayofweek")[0] == 0
    assert all(abs(v) <= 1 for v in by_day(f, "month_sin"))
    few = ops.create_features(series(range(10)), lags=[2], rolling_windows=[3])
    assert "lag_2" in few.columns and "lag_1" not in few.columns


def test_features_do_not_see_their_own_or_later_days(series):
    base = [float(v) for v in range(50)]
    changed = base[:35] + [999.0] * 15
    a, b = (by_day(ops.create_features(series(v)), "rolling_mean_14")[:36] for v in (base, changed))
    assert a == b


def test_lags_count_rows_not_days(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    df = spark.createDataFrame([("g", d, float(i)) for i, d in enumerate(days)], "key string, ds date, y double")
    assert by_day(ops.create_features(df, lags=[1], rolling_windows=[]), "lag_1") == [None, 0.0, 1.0]


def test_split_tail_and_guards(series):
    split = by_day(ops.split_tail(series(range(10)), test=3, val=2), "split")
    assert split == ["train"] * 5 + ["val"] * 2 + ["test"] * 3
    with pytest.raises(ValueError):
        ops.split_tail(series(range(10)), test=0, val=0)
    with pytest.raises(Exception, match="series length"):
        ops.split_tail(series(range(5)), test=3, val=2).collect()


def test_split_cutoff_counts_days(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 20), dt.date(2024, 2, 1)]
    df = spark.createDataFrame([("g", d, 1.0) for d in days], "key string, ds date, y double")
    assert by_day(ops.split_cutoff(df, days=30), "split") == ["train", "test", "test"]


def test_adjacent_windows(series):
    parts = by_day(ops.adjacent_windows(series(range(10)), 3), "part")
    assert parts == ["reference"] * 3 + ["current"] * 3
    with pytest.raises(Exception, match="not enough data"):
        ops.adjacent_windows(series(range(5)), 3).collect()


def hot_rows(n=600):
    """A third of the rows under one key, many at the same minute."""
    rng = random.Random(5)
    return [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", T0 + dt.timedelta(minutes=rng.randrange(20_000))) for i in range(n)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_previous_time_against_brute_force(spark, by):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")
    got = {r["id"]: r["previous"] for r in ops.with_previous(df, "t", by=by, tie=["id"]).collect()}
    last, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        group = k if by else ""
        want[i] = last.get(group)
        last[group] = t
    assert got == want


def test_granularity(spark):
    times = [T0 + dt.timedelta(hours=h) for h in (0, 0, 1, 2, 30, 31)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    row = ops.granularity(df, "t").first()
    assert (row["dominant_seconds"], row["dominant_n"], row["same_ts"]) == (3600.0, 3, 1)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_nearest_join_against_brute_force(spark, by):
    rows = hot_rows(400)
    rng = random.Random(9)
    points = [("hot" if i % 2 else f"k{i % 20}", T0 + dt.timedelta(minutes=rng.randrange(20_000))) for i in range(60)]
    left = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame(points, "k string, p timestamp_ntz")
    got = {r["id"]: r["nearest"] for r in ops.nearest_join(left, right, ts="t", point_ts="p", by=by).collect()}
    assert len(got) == len(rows)
    for i, k, t in rows:
        near = [p for q, p in points if not by or q == k]
        want = min(near, key=lambda p: (abs(p - t), p)) if near else None
        assert got[i] == want


def test_first_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "g string, v int")
    assert sorted(tuple(r)[:2] for r in ops.first_per_group(df, ["g"], ["v"], 2).collect()) == [("a", 0), ("a", 1), ("b", 1)]


def test_autocorrelation(series):
    y = np.sin(np.arange(100) / 3) + np.arange(100) * 0.01
    d = y - y.mean()
    want = [float(np.sum(d[k:] * d[: len(d) - k]) / np.sum(d * d)) for k in range(11)]
    got = ops.autocorrelation(series(y), 10).orderBy("lag").collect()
    assert [r["acf"] for r in got] == pytest.approx(want)


def test_partitioning_does_not_matter(spark, series):
    df = series(np.random.default_rng(0).normal(size=80))
    one, many = (ops.create_features(df.repartition(p)).orderBy("ds").collect() for p in (1, 8))
    assert one == many
    assert df.select(F.count("*")).first()[0] == 80


def test_unknown_keys_and_times_keep_their_rows(spark):
    rows = [(1, None, T0), (2, None, T0 + dt.timedelta(hours=2)), (3, "a", None), (4, "a", T0)]
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")
    got = {r["id"]: r["previous"] for r in ops.with_previous(df, "t", by=["k"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None}
    points = spark.createDataFrame([("a", T0)], "k string, p timestamp_ntz")
    near = {r["id"]: r["nearest"] for r in ops.nearest_join(df, points, ts="t", point_ts="p", by=["k"]).collect()}
    assert near == {1: None, 2: None, 3: None, 4: T0}


@pytest.mark.parametrize("gap", [600, 7200, 200_000])
def test_sessions_against_brute_force(spark, gap):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")
    got = {(r["k"], r["session_start"], r["session_end"], r["n"]) for r in ops.sessionize(df, "t", "k", gap_seconds=gap).collect()}
    want, wait = set(), dt.timedelta(seconds=gap)
    for key in {k for _, k, _ in rows}:
        run = []
        for t in sorted(t for _, k, t in rows if k == key):
            if run and t - run[-1] >= wait:
                want.add((key, run[0], run[-1] + wait, len(run)))
                run = []
            run.append(t)
        want.add((key, run[0], run[-1] + wait, len(run)))
    assert got == want


@pytest.fixture
def slices(monkeypatch):
    """The sliced rows that an operator works on."""
    made, plain = [], ops.in_slices
    monkeypatch.setattr(ops, "in_slices", lambda df, order, n=16: made.append(plain(df, order, n)) or made[-1])
    return made


def half_in_one_day(n=4000):
    """One key holds most rows, one day half of them, one minute a fifth."""
    rng, rows = random.Random(11), []
    for i in range(n):
        minutes = rng.randrange(30) * 1440 + rng.randrange(1440) if i % 2 else 14_400 + (0 if i % 10 < 4 else rng.randrange(1440))
        rows.append((i, "hot" if rng.random() < 0.8 else "cold", T0 + dt.timedelta(minutes=minutes)))
    return rows


def largest(made):
    sizes = [r["count"] for d in made for r in d.groupBy("_slice").count().collect()]
    return max(sizes) / (sum(sizes) / 16)


def test_a_full_day_is_spread_over_slices(spark, slices):
    rows = half_in_one_day()
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz").repartition(6)
    got = {r["id"]: r["previous"] for r in ops.with_previous(df, "t", by=["k"], tie=["id"]).collect()}
    last, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i], last[k] = last.get(k), t
    assert got == want
    assert largest(slices) < 2

    slices.clear()
    points = spark.createDataFrame([("hot", T0 + dt.timedelta(hours=h)) for h in range(0, 800, 7)], "k string, p timestamp_ntz")
    near = {r["id"]: r["nearest"] for r in ops.nearest_join(df, points, ts="t", point_ts="p", by=["k"]).collect()}
    for i, k, t in rows:
        assert near[i] == (min((T0 + dt.timedelta(hours=h) for h in range(0, 800, 7)), key=lambda p: (abs(p - t), p)) if k == "hot" else None)
    assert largest(slices) < 2

    slices.clear()
    sessions = ops.sessionize(df, "t", "k", gap_seconds=300).collect()
    assert sum(r["n"] for r in sessions) == len(rows)
    assert largest(slices) < 2


def test_steps_of_a_full_day(spark, slices):
    rows = half_in_one_day()
    df = spark.createDataFrame([*rows, (-1, "hot", None)], "id int, k string, t timestamp_ntz").repartition(6)
    times = sorted(t for _, _, t in rows)
    want = {}
    for a, b in zip(times, times[1:], strict=False):
        want[(b - a).total_seconds()] = want.get((b - a).total_seconds(), 0) + 1
    assert {r["step_seconds"]: r["n"] for r in ops.step_counts(df, "t").collect()} == want
    assert largest(slices) < 2
    assert ops.step_counts(df.where("false"), "t").collect() == []


def test_a_short_key_need_not_stop_the_others(series):
    both = series(range(3), "short").unionByName(series(range(10), "long"))
    got = {}
    for r in ops.split_tail(both, test=2, val=2, short="train").collect():
        got.setdefault((r["key"], r["split"]), []).append(r["y"])
    assert {k: sorted(v) for k, v in got.items()} == {
        ("short", "train"): [0, 1, 2], ("long", "train"): [0, 1, 2, 3, 4, 5], ("long", "val"): [6, 7], ("long", "test"): [8, 9],
    }
    with pytest.raises(ValueError, match="short"):
        ops.split_tail(both, test=2, short="drop")


def test_slices_grow_in_number_and_not_in_size(spark, monkeypatch):
    from obsflow.operators import slices

    rows = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") % 7 * 1000 + F.col("id") / 10).alias("t"))
    points = spark.range(50).select(F.timestamp_seconds(F.col("id") * 130.0).alias("p"))
    plain = {r.id: r.nearest for r in ops.nearest_join(rows, points, ts="t", point_ts="p").collect()}
    before = {r.id: r.previous for r in ops.with_previous(rows, "t").collect()}
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    sliced = slices.in_slices(rows, ["t"])
    sizes = [r["count"] for r in sliced.groupBy(slices.SLICE).count().collect()]
    assert sliced.rdd.getNumPartitions() == 20 and max(sizes) <= 250
    assert slices.side_by_side(sliced).rdd.getNumPartitions() == 20
    assert {r.id: r.nearest for r in ops.nearest_join(rows, points, ts="t", point_ts="p").collect()} == plain
    assert {r.id: r.previous for r in ops.with_previous(rows, "t").collect()} == before
