"""Mixing to target weights with soft membership.

A softmax classifier, trained in numpy on a bounded sample of a labelled table, gives every document posteriors over domains. Document
``i`` with ``n_i`` tokens and posteriors ``p_i`` adds ``r_i n_i p_i`` to the expected tokens of the domains. The rates ``r >= 0`` are fitted
by projected gradient descent on the squared distance of these totals to the targets, from ``r = 1``. Rows of the least-squares problem are
whitened by the matrix ``sum n p p'`` and columns scaled by ``n``, so one step is ``r <- max(0, r - p . g)`` with one vector ``g`` for all
documents. A step costs one pass over a stored table of posteriors that returns one number per domain; rates follow from the list of ``g``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.features import SIZE, present
from obsflow.llm.language import softmax
from obsflow.llm.text import IS_SPACE, WORD_PIECE_BYTES, pieces, word_spans
from obsflow.llm.toxicity import rows_of
from obsflow.session import checkpointed

PER_DOMAIN = 2000
STEPS, RATE, SPARSITY = 100, 0.1, 3e-4
MAX_DOMAINS = 200
MAX_PASSES, TOLERANCE = 40, 1e-6


def train(texts: list[str], label: np.ndarray, share: np.ndarray, steps: int = STEPS, rate: float = RATE, sparsity: float = SPARSITY):
    """Weights (features x domains) and biases of a sparse softmax; ``share`` is the true share of each domain among labelled rows."""
    bucket, row = rows_of(texts)
    seen, at = np.unique(bucket, return_inverse=True)
    n, d = len(texts), len(share)
    importance = (share / np.maximum(np.bincount(label, minlength=d) / n, 1e-12))[label][:, None] / n
    w, bias = np.zeros((len(seen), d)), np.log(np.maximum(share, 1e-6))
    mean, square = np.zeros((len(seen) + 1, d)), np.zeros((len(seen) + 1, d))
    truth = np.eye(d)[label]
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(row, w[at, j], minlength=n) for j in range(d)], axis=1) + bias
        slope = (softmax(z) - truth) * importance
        g = np.stack([np.append(np.bincount(at, slope[row, j], minlength=len(seen)), slope[:, j].sum()) for j in range(d)], axis=1)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        move = scale * mean / (1 - 0.9**step)
        bias = bias - move[-1]
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * sparsity, 0)
    weights = np.zeros((SIZE, d), np.float32)
    weights[seen] = w
    return weights, bias


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN) -> dict:
    """Train on at most about ``per_domain`` labelled texts of every domain.

    More than ``MAX_DOMAINS`` domains are an error. ``labelled`` has ``doc_id, domain``; of a repeated id the smallest domain counts, other domains and null texts are left out. Without any
    usable row all posteriors are equal.
    """
    if not 0 < len(domains) <= MAX_DOMAINS:
        raise ValueError(f"1 to {MAX_DOMAINS} domains are needed")
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    count = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    even = {"weights": np.zeros((SIZE, len(domains)), np.float32), "bias": np.zeros(len(domains)), "domains": domains}
    if not count:
        return even
    draw = F.pmod(F.xxhash64("doc_id", F.lit("domain sample")), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for d, n in count.items() for x in (d, min(1.0, per_domain / n))])
    picked = known.where(draw < shares[F.col("domain")])
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull()).where(draw < max(min(1.0, per_domain / n) for n in count.values()))
    sample = some.join(picked, "doc_id").select("text", "domain", F.xxhash64("doc_id", "text").alias("key"))
    total = sum(count.values())
    share = np.array([count.get(d, 0) / total for d in domains])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["text", "domain", "key"]), *batches], ignore_index=True)  # no batch at all if nothing is drawn
        if len(rows):
            rows = rows.sort_values("key", kind="stable")  # the same model for any order of rows
            weights, bias = train(list(rows["text"]), np.array([domains.index(d) for d in rows["domain"]]), share)
            at = np.flatnonzero(weights.any(axis=1))
            yield pd.DataFrame({"at": [at.astype(np.int32)], "weight": [weights[at].ravel()], "bias": [bias]})

    row = sample.repartition(1).mapInPandas(run, "at array<int>, weight array<float>, bias array<double>").first()
    if row is None:
        return even
    weights = np.zeros((SIZE, len(domains)), np.float32)
    weights[np.array(row["at"], np.int64)] = np.array(row["weight"], np.float32).reshape(-1, len(domains))
    return {"weights": weights, "bias": np.array(row["bias"]), "domains": domains}


def posteriors(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``tokens`` (words of the whole text, null: 0) and ``posterior``, one share per domain."""
    packed = docs.select("text", F.struct(*keep).alias("row"))
    row_type = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        used, d = weights.any(axis=1), weights.shape[1]
        for batch in batches:
            shares, tokens = [np.zeros((0, d))], [np.zeros(0, np.int64)]
            for lo, hi, data, offsets in pieces(batch.column(0), WORD_PIECE_BYTES):  # a worker's memory goes with the piece
                bucket, text = present(data, offsets, used)
                z = np.stack([np.bincount(text, weights[bucket, j], minlength=hi - lo) for j in range(d)], axis=1) + bias
                shares.append(softmax(z))
                tokens.append(np.bincount(word_spans(~IS_SPACE[data], offsets)[2], minlength=hi - lo).astype(np.int64))
            p = np.concatenate(shares)
            column = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), d).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(tokens)), column], names=["row", "tokens", "posterior"])

    return packed.mapInArrow(run, f"row {row_type}, tokens bigint, posterior array<double>").select("row.*", "tokens", "posterior")


def rate_after(steps: list[np.ndarray]) -> Column:
    """The rate of a document after projected steps from one."""
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("posterior")[j] * F.lit(float(x)) for j, x in enumerate(g)), F.lit(0.0)))
    return r


def fit_rates(shared: DataFrame, targets: list[float], total: float | None = None, anchor: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, the totals wanted, and those reached.

    ``targets`` are weights of the domains. ``total`` is the number of tokens wanted (all there are, by default); with ``anchor`` it is chosen
    so that this domain keeps its expected tokens.
    """
    d = len(targets)
    weight = np.array(targets, float)
    if (weight < 0).any() or not weight.sum() > 0:
        raise ValueError("targets must be nonnegative, one of them positive")
    weight /= weight.sum()
    p, n = [F.col("posterior")[j] for j in range(d)], F.col("tokens").cast("double")
    sums = shared.agg(*[F.sum(n * p[j]) for j in range(d)], *[F.sum(n * p[i] * p[j]) for i in range(d) for j in range(d)]).first()
    now, gram = np.array([x or 0.0 for x in sums[:d]]), np.array([x or 0.0 for x in sums[d:]]).reshape(d, d)
    if anchor is not None and weight[anchor] > 0:
        total = now[anchor] / weight[anchor]
    wanted = weight * (now.sum() if total is None else total)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) if now.sum() > 0 else np.zeros((d, d))
    steps: list[np.ndarray] = []
    while len(steps) < MAX_PASSES and np.abs(now - wanted).sum() > TOLERANCE * max(wanted.sum(), 1.0):
        steps.append(inverse @ (now - wanted))
        r = rate_after(steps)
        before, row = now, shared.agg(*[F.sum(n * p[j] * r) for j in range(d)]).first()
        now = np.array([x or 0.0 for x in row])
        if np.abs(now - before).sum() <= TOLERANCE * max(before.sum(), 1.0):
            break
    return steps, wanted, now


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, anchor: str | None = None,
          keep: list[str] | None = None, per_domain: int = PER_DOMAIN) -> DataFrame:
    """``docs`` (or ``keep`` of its columns) with ``tokens``, ``posterior`` (in the order of ``targets``) and ``rate``, the expected copies.

    An empty text has no tokens and the rate that its posteriors give. Columns of the new names are replaced.
    """
    domains = list(targets)
    model = fit_domains(docs, labelled, domains, per_domain)
    keep = [c for c in (keep or docs.columns) if c not in ("tokens", "posterior", "rate")]
    shared = checkpointed(posteriors(docs, model, keep))
    steps, _, _ = fit_rates(shared, list(targets.values()), total, domains.index(anchor) if anchor else None)
    return shared.withColumn("rate", rate_after(steps))


def mixed_once(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str, per_domain: int = PER_DOMAIN) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each is taken at most once: where a hash of the id falls below the rate.

    The domain ``anchor`` keeps its expected tokens, so documents that surely belong to it have rates of one or more and stay. Null ids hash as
    the empty string.
    """
    domains = list(targets)
    model = fit_domains(docs, labelled, domains, per_domain)
    shared = checkpointed(posteriors(docs, model, ["doc_id"]))
    steps, _, _ = fit_rates(shared, list(targets.values()), anchor=domains.index(anchor))
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")), F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    return posteriors(packed, model, ["_row"]).where(u < rate_after(steps)).select("_row.*")


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from the label columns: toxic texts, texts of low quality, and the good rest."""
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", named.alias("domain")).where("domain is not null")
