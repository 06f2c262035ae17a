import datetime as dt

from pyspark.sql import functions as F

from obsflow.operators import slices


def test_slices_are_balanced_and_in_order(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i % 3 if i % 2 else 0, day + dt.timedelta(seconds=(i % 7) if i % 2 else i), "x") for i in range(8000)] + [(None, None, "x")] * 2000
    df = spark.createDataFrame(rows, "k int, t timestamp, v string").repartition(8)
    cut = slices.in_slices(df, ["k", "t"], 10)
    sizes = [r["count"] for r in cut.groupBy(slices.SLICE).count().collect()]
    assert sum(sizes) == len(rows)
    assert max(sizes) < 2500  # the 2,000 equal rows come from eight partitions
    edges = cut.groupBy(slices.SLICE).agg(F.min(F.struct("k", "t")).alias("a"), F.max(F.struct("k", "t")).alias("b")).where("a.k is not null").orderBy(slices.SLICE).collect()
    assert all(tuple(x["b"]) <= tuple(y["a"]) for x, y in zip(edges, edges[1:], strict=False))


def test_positions_run_over_slices(spark):
    df = spark.createDataFrame([(i % 2 if i % 5 else None, i) for i in range(1000)], "k int, v int")
    cut = slices.in_slices(df, ["k", "v"], 7)
    got = {(r["k"], r["v"]): r["position"] for r in slices.numbered(cut, ["k"], ["v"]).collect()}
    for key in (None, 0, 1):
        values = sorted(v for k, v in got if k == key)
        assert [got[key, v] for v in values] == list(range(1, len(values) + 1))
