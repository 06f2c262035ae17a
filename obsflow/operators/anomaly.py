"""Anomaly flags: population z-score, isolation forest, and their comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.functions.scalar import EULER_GAMMA, detected_by, iso_utc, number, standardize
from obsflow.operators.quantiles import medians, quantiles
from obsflow.session import broadcast_if_small, checkpointed, spread

# The floor of the deviation, the forest's default features and sizes, leaf markers.
SIGMA_FLOOR = 1e-9
DEFAULT_IF_FEATURES = ("temperature_celsius", "humidity", "wind_kph", "pressure_mb", "precip_mm")
N_TREES = 200
MAX_SAMPLES = 256
LEAF_CHILD, LEAF_FEATURE = -1, -2

TREE_SCHEMA = (
    "tree_id int, feature array<int>, threshold array<double>, children_left array<int>,"
    " children_right array<int>, n_node_samples array<int>"
)


def zscore_params(value: Column) -> tuple[Column, Column]:
    """Aggregates for the population mean and the floored deviation."""
    return F.avg(value), F.greatest(F.stddev_pop(value), F.lit(SIGMA_FLOOR))


def zscore_anomalies(df: DataFrame, value: str, *, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``z`` and ``anomaly_zscore``; a missing value is never flagged.

    The global parameters are a scalar subquery of the plan; those of groups are joined, broadcast
    while their counted rows are within bounds. Rows without a group stay, without a score.
    """
    v = number(value)
    mu, sigma = zscore_params(v)
    if by:
        params = broadcast_if_small(df.groupBy(*by).agg(mu.alias("mu"), sigma.alias("sigma")))
        scored = df.join(params, list(by), "left").withColumn("z", (v - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")
    else:
        params = df.agg(F.struct(mu.alias("mu"), sigma.alias("sigma"))).scalar()
        scored = df.withColumn("z", (v - params["mu"]) / params["sigma"])
    return scored.withColumn("anomaly_zscore", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def zscore_with_params(df: DataFrame, value: str, mu: float, sigma: float, *, threshold: float = 3.0) -> DataFrame:
    """Verdict of a stored baseline; a missing value counts as the mean."""
    z = (F.coalesce(number(value), F.lit(mu)) - mu) / sigma
    return df.withColumn("z", z).withColumn("anomaly_zscore", F.abs("z") > threshold)


@dataclass(frozen=True)
class AnomalyModel:
    """One fit of both methods: fill values, scaler, ranges, z-score baseline and the trees."""

    features: list[str]
    medians: list[float]
    mean: list[float]
    scale: list[float]
    minimum: list[float]
    maximum: list[float]
    mu: float
    sigma: float
    max_samples: int
    trees: list[dict] = field(repr=False)
    offset: float = float("nan")
    threshold: float = 3.0

    def standardized(self) -> list[Column]:
        """The scaled feature columns, missing values filled."""
        return [
            standardize(f"`{c}`", F.lit(m), F.lit(mean), F.lit(s)).alias(f"s{i}")
            for i, (c, m, mean, s) in enumerate(zip(self.features, self.medians, self.mean, self.scale))
        ]

    def score(self, df: DataFrame, *, name: str = "if_score") -> DataFrame:
        """Adds the isolation score; the packed trees reach every worker once."""
        packed = df.sparkSession.sparkContext.broadcast(pack_trees(self.trees, self.max_samples))

        @F.pandas_udf("double")
        def score_rows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series(score_matrix(np.vstack([c.to_numpy(dtype=float) for c in columns]), packed.value))

        return df.withColumn(name, score_rows(*self.standardized()))

    def verdicts(self, df: DataFrame, *, temperature: str) -> DataFrame:
        """Both methods on new rows: ``z``, ``anomaly_zscore``, ``if_score``, ``anomaly_if``."""
        with_z = zscore_with_params(df, temperature, self.mu, self.sigma, threshold=self.threshold)
        return self.score(with_z).withColumn("anomaly_if", F.col("if_score") < self.offset)

    def params(self, spark: SparkSession) -> DataFrame:
        """Parameters per feature, with the shared numbers repeated on every row."""
        rows = [
            (f, *numbers, self.mu, self.sigma, self.threshold, self.max_samples, self.offset)
            for f, *numbers in zip(self.features, self.medians, self.mean, self.scale, self.minimum, self.maximum)
        ]
        schema = (
            "feature string, median double, mean double, scale double, min double, max double,"
            " mu double, sigma double, threshold double, max_samples int, offset double"
        )
        return spark.createDataFrame(rows, schema)

    def forest(self, spark: SparkSession) -> DataFrame:
        """The trees as five node arrays each."""
        return spark.createDataFrame([tuple(t.values()) for t in self.trees], TREE_SCHEMA)


def fit_params(df: DataFrame, features: Sequence[str], value: str) -> dict:
    """Medians, scaler, ranges of the filled features and the z-score baseline: two small jobs."""
    middle = {r["feature"]: r["median"] for r in medians(df, list(features)).collect()}
    fills = [F.coalesce(number(f"`{c}`"), F.lit(middle[c])) for c in features]
    mu, sigma = zscore_params(number(value))
    aggs = [mu.alias("mu"), sigma.alias("sigma"), F.count("*").alias("n")]
    for i, v in enumerate(fills):
        aggs += [
            F.avg(v).alias(f"mean{i}"), F.stddev_pop(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    k = range(len(fills))
    return {
        "n": row["n"], "mu": row["mu"], "sigma": row["sigma"],
        "medians": [middle[c] for c in features],
        "mean": [row[f"mean{i}"] for i in k],
        "scale": [row[f"std{i}"] or 1.0 for i in k],
        "minimum": [row[f"min{i}"] for i in k],
        "maximum": [row[f"max{i}"] for i in k],
    }


#: More rows than wanted by so many deviations are expected below the first threshold of a sample.
MARGIN = 6.0
HASHES = 1 << 62


def smallest(rows: DataFrame, n: int, total: int, *, by: Sequence[str], hash_: str, copies: int = 1) -> DataFrame:
    """The ``n`` rows of smallest ``hash_`` (0 to 2^62) per group, with their ``place`` from 1; all rows of smaller groups.

    ``total`` is the number of rows of a group. Rows below a threshold that leaves little more than ``n`` of them are counted, and the threshold is
    raised until every group has enough, so what is ordered is about as large as the sample. Equal rows are one row with a number until their
    places are known.
    """
    share = min(1.0, (n + MARGIN * n**0.5 + 20) / max(total, 1))
    names = [c for c in rows.columns if c not in by]
    while True:
        near = rows.where(F.col(hash_) < int(share * HASHES)) if share < 1 else rows
        counted = checkpointed(near.groupBy(*by, *names).agg(F.count("*").alias("_rows")))
        if share >= 1:
            break
        sizes = counted.groupBy(*by).agg(F.sum("_rows").alias("_n"))
        if sizes.where(F.col("_n") >= n).count() == copies:
            break
        share = min(1.0, 4 * share)
    upto = F.sum("_rows").over(W.partitionBy(*by).orderBy(hash_, *[c for c in names if c != hash_]).rowsBetween(W.unboundedPreceding, 0))
    cut = counted.withColumn("_upto", upto).withColumn("_first", F.col("_upto") - F.col("_rows") + 1).where(F.col("_first") <= n)
    places = F.explode(F.sequence(F.col("_first"), F.least(F.col("_upto"), F.lit(n))))
    return cut.select(*by, *names, places.alias("place"))


def tree_samples(
    df: DataFrame, columns: list[Column], n: int, *, hash_cols: Sequence[str], n_trees: int, size: int, seed: int
) -> DataFrame:
    """``(tree_id, s0..)``: ``size`` rows per tree, chosen by a seeded hash of the row.

    Trees are taken in groups of as many as the table has disjoint samples for. Every group has a hash of its own, and its rows of smallest hash are dealt
    to its trees in turn. The hash is taken of unscaled source columns; rows that agree in them are interchangeable, so the choice does
    not depend on the partitioning.
    """
    if not n:
        return df.select(F.lit(0).alias("tree_id"), *[c.alias(f"s{i}") for i, c in enumerate(columns)]).limit(0)
    names = [f"s{i}" for i in range(len(columns))]
    together = max(1, min(n_trees, n // size))
    groups = -(-n_trees // together)
    rows = df.select(*[c.alias(s) for c, s in zip(columns, names, strict=True)], *[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(hash_cols)])
    offered = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    hash_ = F.pmod(F.xxhash64(*[f"id{i}" for i in range(len(hash_cols))], F.lit(seed), "_group"), F.lit(HASHES))
    chosen = smallest(offered.withColumn("_hash", hash_), together * size, n, by=["_group"], hash_="_hash", copies=groups)
    tree = F.col("_group") * together + F.pmod(F.col("place") - 1, F.lit(together))
    return chosen.withColumn("tree_id", tree.cast("int")).where(F.col("tree_id") < n_trees).select("tree_id", *names)


def grow_tree(x: np.ndarray, seed: Sequence[int], max_depth: int) -> dict[str, list]:
    """Random isolation tree over at most a few hundred rows, as five node arrays."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, -1, 0)]
    while pending:
        rows, depth, parent, side = pending.pop()
        at = len(nodes)
        nodes.append([LEAF_FEATURE, float(LEAF_FEATURE), LEAF_CHILD, LEAF_CHILD, len(rows)])
        if parent >= 0:
            nodes[parent][2 + side] = at
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(rows) <= 1 or len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[rows, f] <= cut
        nodes[at][0], nodes[at][1] = f, cut
        pending.append((rows[~left], depth + 1, at, 1))
        pending.append((rows[left], depth + 1, at, 0))
    columns = list(zip(*nodes))
    names = ("feature", "threshold", "children_left", "children_right", "n_node_samples")
    return {name: list(c) for name, c in zip(names, columns)}


def depth_limit(max_samples: int) -> int:
    return math.ceil(math.log2(max(max_samples, 2)))


def path_length(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def pack_trees(trees: list[dict], max_samples: int) -> dict:
    """Trees laid out as complete binary trees, so that all rows walk down in step.

    Below an early leaf every comparison goes left; the slot reached at the bottom holds the leaf's
    depth plus the expected rest of the path.
    """
    depth = max(_tree_depth(t) for t in trees)
    inner, bottom = 2**depth - 1, 2**depth
    feature = np.zeros((len(trees), max(inner, 1)), dtype=np.int32)
    cut = np.full((len(trees), max(inner, 1)), np.inf)
    length = np.zeros((len(trees), bottom))
    for i, t in enumerate(trees):
        todo = [(0, 0, 0)]
        while todo:
            node, slot, level = todo.pop()
            if t["children_left"][node] == LEAF_CHILD:
                last = slot
                for _ in range(depth - level):
                    last = 2 * last + 1
                length[i, last - inner] = level + path_length(t["n_node_samples"][node])
            else:
                feature[i, slot], cut[i, slot] = t["feature"][node], t["threshold"][node]
                todo.append((t["children_left"][node], 2 * slot + 1, level + 1))
                todo.append((t["children_right"][node], 2 * slot + 2, level + 1))
    return {"depth": depth, "feature": feature, "cut": cut, "length": length, "norm": path_length(max_samples)}


def _tree_depth(t: dict) -> int:
    depth, level = 0, [0]
    while level:
        level = [c for n in level for c in (t["children_left"][n], t["children_right"][n]) if c != LEAF_CHILD]
        depth += bool(level)
    return depth


def score_matrix(x: np.ndarray, packed: dict) -> np.ndarray:
    """Scores of the columns of ``x`` (features by rows)."""
    rows = x.shape[1]
    flat, at = np.ascontiguousarray(x).reshape(-1), np.arange(rows)
    total = np.zeros(rows)
    inner = 2 ** packed["depth"] - 1
    for feature, cut, length in zip(packed["feature"], packed["cut"], packed["length"]):
        node = np.zeros(rows, dtype=np.int64)
        for _ in range(packed["depth"]):
            node = 2 * node + 1 + (flat[feature[node] * rows + at] > cut[node])
        total += length[node - inner]
    return -np.exp2(-(total / len(packed["feature"])) / packed["norm"])


def fit_anomaly_models(
    df: DataFrame,
    *,
    features: Sequence[str] = DEFAULT_IF_FEATURES,
    value: str | None = None,
    id_cols: Sequence[str] = (),
    n_trees: int = N_TREES,
    max_samples: int = MAX_SAMPLES,
    seed: int = 42,
    threshold: float = 3.0,
) -> AnomalyModel:
    """Fit scaler, z-score baseline and forest; the score threshold is set by ``isolation_forest``.

    Each tree is grown in its own task from at most ``max_samples`` rows.
    """
    features = list(features)
    p = fit_params(df, features, value or features[0])
    n = p.pop("n")
    size = min(max_samples, n)
    draft = AnomalyModel(features, **p, max_samples=size, trees=[], threshold=threshold)
    samples = tree_samples(
        df, draft.standardized(), n, hash_cols=[*dict.fromkeys([*features, *id_cols])],
        n_trees=n_trees, size=size, seed=seed,
    )
    names = [f"s{i}" for i in range(len(features))]
    limit = depth_limit(size)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(rows["tree_id"].iloc[0])
        rows = rows.sort_values(names)
        tree = grow_tree(rows[names].to_numpy(dtype=float), [seed, tree_id], limit)
        return pd.DataFrame([{"tree_id": tree_id, **tree}])

    # Model-sized: at most n_trees rows of 2 * max_samples nodes.
    tasks = min(n_trees, df.sparkSession.sparkContext.defaultParallelism)
    grown = samples.repartition(tasks, "tree_id").groupBy("tree_id").applyInPandas(grow, TREE_SCHEMA)
    trees = grown.orderBy("tree_id").collect()
    return AnomalyModel(features, **p, max_samples=size, trees=[r.asDict() for r in trees], threshold=threshold)


def with_offset(model: AnomalyModel, scored: DataFrame, contamination: float) -> AnomalyModel:
    """The model with the score below which a share of ``contamination`` of the rows lies."""
    cut = quantiles(scored, ["if_score"], {"offset": contamination})
    offset = cut.first()["offset"]
    return AnomalyModel(**{**model.__dict__, "offset": offset})


def isolation_forest(
    df: DataFrame, features: Sequence[str], *, contamination: float = 0.02, **fit_settings
) -> tuple[DataFrame, AnomalyModel]:
    """Adds ``if_score`` and ``anomaly_if``, and returns the model.

    Scoring is the costly step, so the scores are stored once and then read for the threshold and the
    flags.
    """
    model = fit_anomaly_models(df, features=features, **fit_settings)
    scored = checkpointed(model.score(spread(df)))
    model = with_offset(model, scored, contamination)
    return scored.withColumn("anomaly_if", F.col("if_score") < model.offset), model


def overlap_count(flags: DataFrame, a: str, b: str) -> DataFrame:
    return flags.agg(F.count_if(F.col(a) & F.col(b)).alias("overlap"))


def method_comparison(flags: DataFrame, a: str = "anomaly_zscore", b: str = "anomaly_if") -> DataFrame:
    """``(label, count, share_pct)`` of rows flagged by both, one or no method."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    segments = {"both": x & y, "zscore_only": x & ~y, "if_only": ~x & y, "neither": ~(x | y)}
    row = flags.agg(F.count("*").alias("n"), *[F.count_if(c).alias(s) for s, c in segments.items()])
    items = [
        F.struct(F.lit(s).alias("label"), F.col(s).alias("count"), (F.col(s) / F.col("n") * 100).alias("share_pct"))
        for s in segments
    ]
    return row.select(F.inline(F.array(*items)))


def method_summary(
    flags: DataFrame, *, threshold: float, contamination: float, a: str = "anomaly_zscore", b: str = "anomaly_if"
) -> DataFrame:
    """One row: threshold, count and share per method, and the overlap (shares not rounded)."""
    x, y = F.col(a), F.col(b)
    return flags.agg(
        F.lit(threshold).alias("z_threshold"),
        F.count_if(x).alias("z_count"),
        (F.count_if(x) / F.count("*") * 100).alias("z_share_pct"),
        F.lit(contamination).alias("if_contamination"),
        F.count_if(y).alias("if_count"),
        (F.count_if(y) / F.count("*") * 100).alias("if_share_pct"),
        F.count_if(x & y).alias("overlap_count"),
    )


def anomaly_records(
    flags: DataFrame, *, ts: str, country: Column, lat: Column, lon: Column, temp: Column, z: str = "z",
    score: str = "if_score", a: str = "anomaly_zscore", b: str = "anomaly_if",
) -> DataFrame:
    """Flagged rows with known position in the published shape and rounding."""
    shaped = flags.where(F.col(a) | F.col(b)).select(
        iso_utc(ts).alias("ts"),
        F.coalesce(country.cast("string"), F.lit("Unknown")).alias("country"),
        F.bround(lat, 4).alias("lat"),
        F.bround(lon, 4).alias("lon"),
        F.bround(temp, 2).alias("temp_c"),
        F.bround(F.col(z), 3).alias("z"),
        F.bround(F.col(score), 4).alias("if_score"),
        detected_by(F.col(a), F.col(b)).alias("detected_by"),
    )
    return shaped.dropna(subset=["lat", "lon"])


def arithmetic_hash(key: Column, salt: int) -> Column:
    """Multiplicative hash of an integer key to 0..2^32-1, kept clear of overflow."""
    small = F.pmod(key.cast("long") + salt, F.lit(2147483648))
    return small * F.lit(2654435761) % F.lit(4294967296)


def hash_sample(df: DataFrame, n: int, key: Column, *, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded arithmetic hash of an integer key, or all if fewer; rows without a key are no candidates
    while there are enough others.

    Fixed size and repeatable, whatever the partitioning. Only rows below a counted threshold are ordered, so a task gets about ``n`` rows and
    not ``n`` from every partition.
    """
    hashed = df.withColumn("_h", arithmetic_hash(key, seed)).withColumn("_key", key)
    total = hashed.agg(F.count("_h")).first()[0]
    share = (n + MARGIN * n**0.5 + 20) / max(total, 1)
    while share < 1:
        near = hashed.where(F.col("_h") < int(share * (1 << 32)))
        if near.limit(n).count() == n:
            hashed = near
            break
        share *= 4
    return hashed.orderBy(F.asc_nulls_last("_h"), "_key").limit(n).drop("_h", "_key")


def hash_split(df: DataFrame, key: Column, *, share: float = 0.2, salt: int = 0) -> DataFrame:
    """Adds ``part``: ``test`` for about ``share`` of the keys, the rest ``train``. Splits with different salts are independent of each other."""
    first = arithmetic_hash(key, salt)
    if salt:  # a shifted key would only shift the hash, so halves trade places and are mixed again
        turned = F.pmod((first % 65536) * 65536 + F.floor(first / 65536) + F.lit(salt) * 40503, F.lit(4294967296))
        first = F.floor((turned % 2147483648) * F.lit(2654435761) % F.lit(4294967296) / 4096)
    bucket = first % 1000
    return df.withColumn("part", F.when(bucket < int(share * 1000), "test").otherwise("train"))
