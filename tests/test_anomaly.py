import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.functions import scalar
from obsflow.operators import anomaly

NAMES = ["a", "b", "c"]


def points(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double")


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(42)
    return points(spark, np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(8, 1, (10, 3))]))


@pytest.fixture(scope="module")
def fitted(clusters):
    scored, model = anomaly.isolation_forest(clusters, NAMES, contamination=0.05, n_trees=50)
    return scored, model


def test_spike_is_the_only_flag(spark):
    df = spark.createDataFrame([(10.0,)] * 50 + [(1000.0,), (None,)], "v double")
    got = anomaly.zscore_anomalies(df, "v")
    assert [r["v"] for r in got.where("anomaly_zscore").collect()] == [1000.0]
    row = got.agg(F.avg("z"), F.stddev_pop("z")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)


def test_constant_column_is_never_flagged(spark):
    df = spark.createDataFrame([(5.0,)] * 5, "v double")
    assert anomaly.zscore_anomalies(df, "v").where("anomaly_zscore").isEmpty()


def test_nan_is_not_flagged(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert anomaly.zscore_anomalies(df, "v").where("anomaly_zscore").isEmpty()


def test_far_cluster_is_flagged(fitted):
    scored, model = fitted
    rows = scored.collect()
    assert all(-1 < r["if_score"] < 0 for r in rows)
    flagged = [r for r in rows if r["anomaly_if"]]
    assert 8 <= len(flagged) <= 12 and np.mean([r["a"] > 4 for r in flagged]) > 0.8
    more = scored.where(F.col("if_score") < anomaly.with_offset(model, scored, 0.2).offset).count()
    assert more >= len(flagged)


def test_fit_does_not_depend_on_partitioning(clusters, fitted):
    again = anomaly.fit_anomaly_models(clusters.repartition(7), features=NAMES, n_trees=50)
    for a, b in zip(again.trees, fitted[1].trees, strict=True):
        assert a["feature"] == b["feature"] and a["n_node_samples"] == b["n_node_samples"]
        assert a["threshold"] == pytest.approx(b["threshold"])


def test_other_seed_gives_other_trees(clusters, fitted):
    assert anomaly.fit_anomaly_models(clusters, features=NAMES, n_trees=50, seed=1).trees != fitted[1].trees


def test_trees_have_five_equal_arrays(spark, fitted):
    model = fitted[1]
    table = model.forest(spark).collect()
    assert len(table) == 50
    for t in table:
        assert len({len(t[c]) for c in ("feature", "threshold", "children_left", "children_right", "n_node_samples")}) == 1
        assert t["n_node_samples"][0] == model.max_samples
        assert all((f == -2) == (c == -1) for f, c in zip(t["feature"], t["children_left"]))


def walk(tree, x):
    node, depth = 0, 0
    while tree["children_left"][node] != -1:
        left = x[tree["feature"][node]] <= tree["threshold"][node]
        node = tree["children_left" if left else "children_right"][node]
        depth += 1
    return depth + anomaly.path_length(tree["n_node_samples"][node])


def test_packed_scores_equal_a_plain_walk(fitted):
    model = fitted[1]
    x = np.random.default_rng(1).normal(0, 3, (40, 3))
    want = [-(2 ** (-np.mean([walk(t, row) for t in model.trees]) / anomaly.path_length(model.max_samples))) for row in x]
    got = anomaly.score_matrix(x.T, anomaly.pack_trees(model.trees, model.max_samples))
    assert got == pytest.approx(want, abs=1e-12)


def test_missing_values_are_filled_when_scoring(spark, fitted):
    model = fitted[1]
    df = spark.createDataFrame([(None, 0.0, 0.0), (model.medians[0], 0.0, 0.0)], "a double, b double, c double")
    a, b = (r["if_score"] for r in model.score(df).collect())
    assert a == b
    row = model.verdicts(df, temperature="a").first()
    assert row["z"] == 0.0 and row["anomaly_zscore"] is False


def test_large_table_samples_are_disjoint(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    rows = anomaly.tree_samples(df, [F.col("a").alias("s0")], 1000, hash_cols=["a"], n_trees=10, size=50, seed=1).collect()
    assert len({r["s0"] for r in rows}) == 500
    assert {sum(r["tree_id"] == k for r in rows) for k in range(10)} == {50}


def test_overlap_and_comparison(spark):
    flags = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "x boolean, y boolean")
    assert anomaly.overlap_count(flags, "x", "y").first()[0] == 1
    assert {r["label"]: r["count"] for r in anomaly.method_comparison(flags, "x", "y").collect()} == {
        "both": 1, "zscore_only": 1, "if_only": 1, "neither": 1,
    }


def test_path_length_column_equals_function(spark):
    got = spark.range(6).select(scalar.average_path_length(F.col("id")).alias("c")).collect()
    assert [r["c"] for r in got] == pytest.approx([anomaly.path_length(n) for n in range(6)])


def test_hash_sample_is_fixed_size_and_repeatable(spark):
    df = spark.range(500)
    a, b = (sorted(r["id"] for r in anomaly.hash_sample(df.repartition(p), 50, F.col("id")).collect()) for p in (1, 6))
    assert a == b and len(a) == 50
    assert anomaly.hash_sample(df, 1000, F.col("id")).count() == 500


def test_hash_split_share(spark):
    n = anomaly.hash_split(spark.range(10_000), F.col("id")).where("part = 'test'").count()
    assert 1800 < n < 2200


def test_phrases(spark):
    rows = [(52.3, 4.1), (31.0, 2.0), (22.0, 0.0), (15.0, None), (10.0, -2.5), (-5.0, 0.0), (-30.2, -3.8), (None, 1.0)]
    df = spark.createDataFrame(rows, "t double, z double")
    got = [r[0] for r in df.select(scalar.temperature_phrase(F.col("t"), F.col("z"))).collect()]
    words = [
        "a severe scorching, extreme heat", "a notable very hot", "an warm", "an mild", "a notable cold", "an very cold",
        "a severe freezing, extreme cold", "an anomalous",
    ]
    assert got == [f"{w} temperature anomaly" for w in words]


def test_rendered_sentence(spark):
    df = spark.createDataFrame([("2024-07-01T00:00:00Z", "Kuwait", 52.3, 4.1, "both")], "ts string, c string, t double, z double, d string")
    text = df.select(scalar.render_record(*[F.col(c) for c in ("ts", "c", "t", "z", "d")])).first()[0]
    assert text == (
        "On 2024-07-01, Kuwait experienced a severe scorching, extreme heat temperature anomaly: "
        "temperature 52.3C, z-score 4.1, detected by both."
    )


@pytest.mark.parametrize("n", [30, 400, 4000, 40_000])
def test_one_design_of_samples_for_every_size(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % n).cast("double").alias("a"))

    def drawn(parts):
        rows = anomaly.tree_samples(
            df.repartition(parts), [F.col("a")], n, hash_cols=["a"], n_trees=12, size=min(50, n), seed=1
        ).collect()
        return {i: sorted(r["s0"] for r in rows if r["tree_id"] == i) for i in range(12)}

    one, many = drawn(1), drawn(8)
    assert one == many
    assert all(len(v) == min(50, n) == len(set(v)) for v in one.values())
    if n >= 400:
        assert len({tuple(v) for v in one.values()}) == 12
    if n >= 4000:
        assert len({x for v in one.values() for x in v}) == 600  # disjoint


def test_samples_of_a_hot_value(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("a"))
    rows = anomaly.tree_samples(df, [F.col("a")], 9000, hash_cols=["a"], n_trees=6, size=100, seed=3).collect()
    assert len(rows) == 600 and {r["tree_id"] for r in rows} == set(range(6))


def test_a_sample_is_the_head_of_the_hash_order(spark):
    df = spark.range(20_000).withColumn("key", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    got = sorted(r["id"] for r in anomaly.hash_sample(df, 300, F.col("key")).collect())
    want = df.where("key is not null").withColumn("h", anomaly.arithmetic_hash(F.col("key"), 42)).orderBy("h", "key").limit(300)
    assert got == sorted(r["id"] for r in want.collect())
    assert anomaly.hash_sample(df, 19_000, F.col("key")).count() == 19_000


def test_nested_splits_are_independent(spark):
    df = spark.range(100_000)
    inner = anomaly.hash_split(anomaly.hash_split(df, F.col("id")).where("part = 'train'").drop("part"), F.col("id"), salt=7)
    share = inner.agg(F.avg((F.col("part") == "test").cast("double"))).first()[0]
    assert abs(share - 0.2) < 0.005
    both = anomaly.hash_split(df, F.col("id"), salt=1).withColumnRenamed("part", "p1")
    both = anomaly.hash_split(both, F.col("id"), salt=2)
    assert abs(both.agg(F.avg(((F.col("p1") == "test") & (F.col("part") == "test")).cast("double"))).first()[0] - 0.04) < 0.004
