import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.operators import quantiles as engine
from obsflow.operators.profile import average_ranks
from obsflow.operators.quantiles import order_statistics, quantiles

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.98, "e": 1.0}
INF = float("inf")
#: Coarse sketches, so that three thousand rows need all three passes.
COARSE = {"grid": 50, "accuracy": 1000, "hold": 30}


def values(kind, n=3000):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 10, n)
    if kind == "tail":
        x = rng.lognormal(0, 3, n)
        x[0] = 1e300
    if kind == "hot":
        x[: n // 3] = 42.0
    if kind == "constant":
        x[:] = 7.0
    if kind == "infinite":
        x[:40], x[40:90] = -INF, INF
    if kind == "huge":
        x[::3], x[1::3] = 1e308, -1e308
    if kind == "only infinite":
        x[: n // 2], x[n // 2 :] = -INF, INF
    return x


KINDS = ["tail", "hot", "constant", "infinite", "huge", "only infinite"]


def frame(spark, x, parts=4):
    return spark.createDataFrame([(float(v),) for v in x], "v double").repartition(parts)


@pytest.fixture
def passes(monkeypatch):
    """How often the rows are read again after the first sketch."""
    calls = []
    plain = engine._count
    monkeypatch.setattr(engine, "_count", lambda *a: calls.append(1) or plain(*a))
    return calls


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("sketch", [{}, COARSE])
def test_every_rank_in_at_most_three_passes(spark, passes, kind, sketch):
    x = np.sort(values(kind))
    ranks = {str(k): (lambda n, k=k: F.lit(k)) for k in (0, 1, 39, 40, 700, 1000, 1500, 2950, 2999)}
    rows = order_statistics(frame(spark, x), ["v"], ranks, **sketch).collect()
    assert {r["stat"]: r["value"] for r in rows} == {s: x[int(s)] for s in ranks}
    assert {(r["n"], r["min"], r["max"]) for r in rows} == {(3000, x[0], x[-1])}
    assert len(passes) <= 2


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("sketch", [COARSE])
def test_matches_interpolation(spark, kind, sketch):
    x = np.sort(values(kind))
    row = quantiles(frame(spark, x), ["v"], PROBS, **sketch).first()
    assert row["n"] == len(x)
    for name, p in PROBS.items():
        place = (len(x) - 1) * p
        lo, hi = x[math.floor(place)], x[math.ceil(place)]
        if lo == hi or place == math.floor(place):
            assert row[name] == lo
        elif math.isinf(lo) and math.isinf(hi):
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(lo * (1 - place % 1) + hi * (place % 1), rel=1e-12)


def test_a_sketch_that_is_too_coarse_is_found_out(spark, passes):
    """An accuracy far below the grid gives wrong brackets; the counts refute them and the result stays exact."""
    x = np.sort(values("tail", 5000))
    ranks = {str(k): (lambda n, k=k: F.lit(k)) for k in (0, 13, 2500, 4321, 4999)}
    rows = order_statistics(frame(spark, x), ["v"], ranks, grid=400, accuracy=20, hold=500).collect()
    assert {r["stat"]: r["value"] for r in rows} == {s: x[int(s)] for s in ranks}


def test_groups_nulls_and_nan(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", float("nan")), ("b", 5.0), (None, 9.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for sketch in ({}, COARSE):
        got = {r["g"]: (r["n"], r["m"]) for r in quantiles(df, ["v"], {"m": 0.5}, by=["g"], **sketch).collect()}
        assert got == {"a": (2, 2.0), "b": (1, 5.0)}
    every = order_statistics(df, ["v"], {"last": lambda n: F.col("rows") - 1}, by=["g"]).collect()
    assert every == []  # beyond the known values of each group


def test_many_groups_and_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(x), int(y)) for g, x, y in zip(rng.integers(0, 40, 4000) ** 2 // 40, rng.normal(size=4000), rng.integers(0, 5, 4000), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = {(r["g"], r["feature"]): (r["q"], r["m"]) for r in quantiles(df, ["x", "y"], {"q": 0.1, "m": 0.5}, by=["g"], **COARSE).collect()}
    for (g, feature), pair in got.items():
        mine = [r[1 if feature == "x" else 2] for r in rows if r[0] == g]
        assert pair == pytest.approx(tuple(np.quantile(mine, [0.1, 0.5])), rel=1e-12)
    assert len(got) == 2 * len({r[0] for r in rows})


def test_empty_table(spark):
    assert quantiles(spark.createDataFrame([], "v double"), ["v"], PROBS).collect() == []
    assert quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], PROBS).collect() == []


def test_sketch_is_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    assert abs(quantiles(df, ["v"], {"m": 0.5}, exact=False).first()["m"] - 5000) < 20


def test_partitioning_does_not_matter(spark):
    results = {quantiles(frame(spark, values("tail"), p), ["v"], {"m": 0.37}, **COARSE).first()["m"] for p in (1, 8)}
    assert len(results) == 1


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 5, 5, 9, 1, 1, 7])], "id int, v int")
    got = {r["id"]: r["avg_rank"] for r in average_ranks(df, "v").collect()}
    assert got == {3: 1, 6: 2, 0: 4, 1: 4, 2: 4, 4: 6, 5: 6}


def test_average_ranks_keep_unknown_values(spark):
    rng = np.random.default_rng(8)
    x = [None if i % 7 == 0 else int(v) for i, v in enumerate(rng.integers(0, 900, 2000))]
    got = {r["id"]: r["avg_rank"] for r in average_ranks(spark.createDataFrame(list(enumerate(x)), "id int, v int"), "v").collect()}
    known = sorted((v for v in x if v is not None), reverse=True)
    first = {v: known.index(v) for v in set(known)}
    assert got == {i: None if v is None else int(first[v] + (known.count(v) + 1) / 2) for i, v in enumerate(x)}
