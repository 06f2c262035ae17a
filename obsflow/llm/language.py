"""Language identification with averaged hashed subword embeddings and a linear softmax.

Every word (a run of letters, with a space on either side) gives its byte 3-grams and 4-grams, hashed into ``BUCKETS`` rows of an
embedding. A text is the mean of its rows, a softmax over learned languages follows. Training is mini-batch stochastic gradient
descent in numpy inside one task, over a bounded sample of labelled texts (``per_language`` of each language, expected). A fifth of the
sample is kept back to fit a temperature and the rejection threshold. Scoring reads whole texts in Arrow batches: embedding and
softmax collapse into one table of logits per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.text import LETTERS, WORD_PIECE_BYTES, pieces

BUCKETS, DIM = 1 << 15, 16
PIECE_GRAMS = 256
MAX_LANGUAGES = 1000
SPACE = np.uint8(32)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3-grams and for 4-grams: bucket and text of every subword, in the order of texts."""
    n, texts = len(data), len(offsets) - 1
    line = np.full(n + texts + 4, SPACE)  # a space before every text
    owner = np.repeat(np.arange(texts), np.diff(offsets) + 1)
    line[np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = LETTERS[data]
    wide = line.astype(np.uint32)
    inner = line[1 : n + texts + 1] != SPACE
    found = []
    for inside, factor in ((inner, 2654435761), (inner & (line[2 : n + texts + 2] != SPACE), 2246822519)):
        at = np.flatnonzero(inside)
        code = wide[at] | wide[at + 1] << np.uint32(8) | wide[at + 2] << np.uint32(16)
        if factor == 2246822519:
            code |= wide[at + 3] << np.uint32(24)
        found.append(((code * np.uint32(factor) >> np.uint32(17)).astype(np.int32), owner[at]))
    return found


def text_logits(table: np.ndarray, bias: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean logits of every text."""
    n = len(offsets) - 1
    sums, count = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for bucket, text in grams(data, offsets):
        if len(text):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            sums[text[first]] += np.add.reduceat(table[bucket], first, axis=0)
            count += np.bincount(text, minlength=n)
    return sums / np.maximum(count, 1)[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], keys: list[int], epochs: int = 4, rate: float = 6.0, seed: int = 7,
          accepted_error: float = 0.01) -> dict:
    """Fit embeddings and softmax; returns the logit table, bias, languages, temperature and rejection threshold."""
    names = sorted(set(languages))
    order = np.argsort(np.array(keys, np.int64), kind="stable")  # the same model for any order of rows
    texts, y = [texts[i] for i in order], np.array([names.index(languages[i]) for i in order])
    held = np.arange(len(texts)) % 5 == 4
    bucket, owner, label = [], [], []
    pieces_so_far = 0
    column = pa.array(texts, pa.large_string())
    for lo, _, data, offsets in pieces(column):
        b, t = (np.concatenate(x) for x in zip(*grams(data, offsets), strict=True))
        by_text = np.argsort(t, kind="stable")
        b, t = b[by_text], t[by_text]
        use = ~held[lo + t]
        b, t = b[use], t[use]
        begin = np.searchsorted(t, t)  # first gram of the same text
        part = (np.arange(len(t)) - begin) // PIECE_GRAMS
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
        bucket.append(b)
        owner.append(np.cumsum(new) - 1 + pieces_so_far)
        label.append(y[lo + t[new]])
        pieces_so_far += int(new.sum())
    bucket, owner, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (bucket, owner, label))
    rng = np.random.default_rng(seed)
    classes = len(names)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    bounds = np.searchsorted(owner, np.arange(len(label) + 1))
    share = np.bincount(label, minlength=classes) / max(len(label), 1)
    importance = 1 / np.maximum(share, 1e-9) / classes if len(label) else share
    batch = 128
    steps = epochs * (-(-len(label) // batch))
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(label))
        for lo in range(0, len(label), batch):
            some = shuffled[lo : lo + batch]
            size = bounds[some + 1] - bounds[some]
            first = np.cumsum(size) - size
            at = np.repeat(bounds[some] - first, size) + np.arange(size.sum())
            rows = bucket[at]
            hidden = np.add.reduceat(emb[rows], first, axis=0) / size[:, None]
            p = softmax(hidden @ weight + bias)
            p[np.arange(len(some)), label[some]] -= 1
            p *= importance[label[some]][:, None] / len(some)
            lr = rate * (1 - step / steps)
            back = (p @ weight.T / size[:, None]).astype(np.float32) * np.float32(len(some))
            weight -= np.float32(lr) * (hidden.T @ p).astype(np.float32)
            bias -= np.float32(lr) * p.sum(axis=0).astype(np.float32)
            spread = np.repeat(back, size, axis=0)
            for d in range(DIM):
                emb[:, d] -= np.float32(lr) * np.bincount(rows, spread[:, d], minlength=BUCKETS).astype(np.float32)
            step += 1
    table = emb @ weight
    rest = np.flatnonzero(held)
    temperature, threshold = 1.0, 0.0
    if len(rest) and classes > 1:
        z = np.concatenate([text_logits(table, bias, d, o) for _, _, d, o in pieces(pa.array([texts[i] for i in rest], pa.large_string()))])
        t = y[rest]
        grid = 2.0 ** np.arange(-3, 4.01, 0.25)
        loss = [-np.log(np.maximum(softmax(z * g)[np.arange(len(t)), t], 1e-12)).mean() for g in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z * temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == t
        ranked = np.argsort(-score, kind="stable")
        wrong = np.cumsum(~right[ranked]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(wrong <= accepted_error)
        if len(good) and good[-1] < len(t) - 1:
            threshold = float(score[ranked[good[-1]]])
        elif not len(good):
            threshold = float(score.max())
    return {"table": table.astype(np.float32), "bias": bias.astype(np.float32), "languages": names, "temperature": temperature, "threshold": threshold}


def fit_language(docs: DataFrame, held_out, per_language: int = 1000) -> dict:
    """Train on at most about ``per_language`` texts of every language, outside ``held_out`` (a boolean column).

    Rows without language, text or letter teach nothing; without any other row every text is ``und``. The sample is bounded by its parameter; it is picked by
    the hash of ``doc_id`` and ``text``, so rows without an id are drawn one by one and repeated rows together, and trained in one task, of which the model alone
    returns. More than ``MAX_LANGUAGES`` languages are an error.
    """
    known = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held")).where(
        "not held and lang is not null and text is not null"
    ).where(F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    nothing = {"table": np.zeros((BUCKETS, 1), np.float32), "bias": np.zeros(1, np.float32), "languages": ["und"], "temperature": 1.0, "threshold": 0.0}
    if not sizes:
        return nothing
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    sample = known.where(draw < share[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", "text").alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["text", "lang", "key"]), *batches], ignore_index=True)  # no batch at all if nothing is drawn
        if len(rows):
            m = train(list(rows["text"]), list(rows["lang"]), list(rows["key"]))
            yield pd.DataFrame({"table": [m["table"].tobytes()], "bias": [m["bias"].tobytes()], "languages": [m["languages"]],
                                "temperature": [m["temperature"]], "threshold": [m["threshold"]]})

    row = sample.repartition(1).mapInPandas(run, "table binary, bias binary, languages array<string>, temperature double, threshold double").first()
    if row is None:  # nothing was drawn
        return nothing
    classes = len(row["languages"])
    return {"table": np.frombuffer(row["table"], np.float32).reshape(BUCKETS, classes), "bias": np.frombuffer(row["bias"], np.float32),
            "languages": list(row["languages"]), "temperature": row["temperature"], "threshold": row["threshold"]}


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred, lang_score, lang_rejected`` for every row of ``docs``, beside its columns (or those in ``keep``).

    A null text and a text without any letter is ``und`` with score 0 and rejected; other texts are rejected below the calibrated
    threshold. Columns of the new names are replaced.
    """
    spark: SparkSession = docs.sparkSession
    new = ("lang_pred", "lang_score", "lang_rejected", "_has_letter")
    base = [c for c in (keep or docs.columns) if c not in new]
    packed = docs.select(F.col("text").alias("t"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("l"), F.struct(*base).alias("row"))
    shared = spark.sparkContext.broadcast(model)
    row_type = packed.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m["languages"], object)
        for batch in batches:
            z = [text_logits(m["table"], m["bias"], d, o) for _, _, d, o in pieces(batch.column("t"), WORD_PIECE_BYTES)]
            p = softmax(np.concatenate(z) * m["temperature"]) if z else np.zeros((0, len(names)))
            letter = batch.column("l").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letter, names[p.argmax(axis=1)], "und")
            score = np.where(letter, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(pred, pa.string()), pa.array(score), pa.array(~letter | (score < m["threshold"]))],
                names=["row", "lang_pred", "lang_score", "lang_rejected"],
            )

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    out = StructType().add("row", row_type).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_rejected", BooleanType())
    return packed.mapInArrow(run, out).select("row.*", "lang_pred", "lang_score", "lang_rejected")
