"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled texts, of which an unknown part is toxic, take the place of negatives. With the
class prior ``p`` the risk of the negatives is that of the unlabelled texts less ``p`` times that of positives taken as negative; where this
estimate falls below zero the step goes against it (the non-negative correction), so the model can't memorise the positives. The model is
linear in hashed presence features with a logistic loss and soft-thresholded weights, trained in numpy in one task on a bounded sample;
scoring reads whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.features import SIZE, present
from obsflow.llm.text import pieces

POSITIVES, UNLABELLED = 2500, 7500
STEPS, RATE, SPARSITY = 120, 0.1, 5e-4


def rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every present feature."""
    found = [(b, lo + t) for lo, _, d, o in pieces(pa.array(texts, pa.large_string())) for b, t in [present(d, o)]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = STEPS, rate: float = RATE,
          sparsity: float = SPARSITY) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk."""
    (pb, pr), (ub, ur) = rows_of(positive), rows_of(unlabelled)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    seen, at = np.unique(np.concatenate([pb, ub]), return_inverse=True)
    pb, ub = at[: len(pb)], at[len(pb) :]
    w, bias = np.zeros(len(seen)), 0.0
    mean, square = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    for step in range(1, steps + 1):
        sp = sigmoid(np.bincount(pr, w[pb], minlength=n_p)[:n_p] + bias)
        su = sigmoid(np.bincount(ur, w[ub], minlength=n_u)[:n_u] + bias)
        # Logistic loss: as negatives the texts cost -log(1 - s), with slope s; as positives -log(s), with slope s - 1.
        negative = -np.log1p(-su).mean() + prior * np.log1p(-sp).mean()
        gp, gu = (np.full(n_p, -prior / n_p), su / n_u) if negative >= 0 else (prior * sp / n_p, -su / n_u)
        g = np.bincount(pb, gp[pr], minlength=len(seen)) + np.bincount(ub, gu[ur], minlength=len(seen))
        g = np.append(g, gp.sum() + gu.sum())
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        move = scale * mean / (1 - 0.9**step)
        bias -= float(move[-1])
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * sparsity, 0)
    weights = np.zeros(SIZE, np.float32)
    weights[seen] = w
    return weights, bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Train on at most about so many confirmed toxic and so many unlabelled texts, none of them in ``held_out``.

    Unlabelled are the texts without a row in ``labels``, or all texts where each has one. The prior is the toxic share of the labelled
    training rows. Both samples are picked by the hash of ``doc_id``, trained in one task, and only the weights that are not zero return.
    Without confirmed or usable texts all scores are alike, and low; repeated rows are drawn together, and a table without rows gives none.
    With fewer than about 75 confirmed texts the ranking holds, but hardly any text reaches a score of a half.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = F.coalesce(held_out, F.lit(False))
    usable = docs.select("doc_id", "text", held.alias("held")).where("not held and text is not null and doc_id is not null").drop("held")
    labelled = known.where(~held)
    counts = labelled.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not counts["p"]:
        return {"weights": np.zeros(SIZE, np.float32), "bias": -1.0, "prior": 0.0}
    prior = min(max(counts["p"] / counts["n"], 1e-3), 0.9)
    total = docs.where(~held).select(F.count(F.lit(1))).first()[0]
    free = max(total - counts["n"], 0) or max(total, 1)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    wanted = labelled.where(F.col("toxic") == 1).where(draw < min(1.0, positives / counts["p"])).select("doc_id", F.lit(1).alias("positive"))
    some = usable.where(draw < min(1.0, max(positives / counts["p"], unlabelled / free)))
    joined = some.join(wanted, "doc_id", "left").join(labelled.select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    unknown = F.col("known").isNull() if total > counts["n"] else F.lit(True)
    role = F.when(F.col("positive") == 1, 1).when(unknown & (draw < min(1.0, unlabelled / free)), 0)
    sample = joined.select("text", role.alias("role"), F.xxhash64("doc_id", "text").alias("key")).where("role is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["text", "role", "key"]), *batches], ignore_index=True)  # no batch at all if nothing is drawn
        if len(rows):
            rows = rows.sort_values("key", kind="stable")  # the same model for any order of rows
            weights, bias = train(list(rows["text"][rows["role"] == 1]), list(rows["text"][rows["role"] == 0]), prior)
            some = np.flatnonzero(weights)
            yield pd.DataFrame({"at": [some.astype(np.int32)], "weight": [weights[some]], "bias": [bias]})

    row = sample.repartition(1).mapInPandas(run, "at array<int>, weight array<float>, bias double").first()
    weights = np.zeros(SIZE, np.float32)
    if row is not None:
        weights[np.array(row["at"], np.int64)] = row["weight"]
    return {"weights": weights, "bias": row["bias"] if row else -1.0, "prior": prior}


def score_toxicity(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (score of a half or more). A null text counts as empty."""
    packed = docs.select("text", F.struct(*keep).alias("row"))
    row_type = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        used = weights != 0
        for batch in batches:
            scores = []
            for lo, hi, data, offsets in pieces(batch.column(0)):
                bucket, text = present(data, offsets, used)
                scores.append(sigmoid(np.bincount(text, weights[bucket], minlength=hi - lo) + bias))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "score", "predicted"]
            )

    return packed.mapInArrow(run, f"row {row_type}, score double, predicted int").select("row.*", "score", "predicted")
