"""Cosine search of records and texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.functions.scalar import round_vector
from obsflow.session import broadcast_if_small

HIT_SCHEMA = "query_id long, doc_id long, score double"
# At most this many query vectors travel to every worker; more are searched block by block.
BROADCAST_QUERIES = 1024
# So many blocks of either side meet in one group: every vector travels once per group of the other side.
GROUP_BLOCKS = 32


def unit_rows(vectors: np.ndarray, floor: float | None = None) -> np.ndarray:
    """Rows at length 1; a zero row stays zero (``floor``: smallest length divided by)."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / (np.maximum(lengths, floor) if floor else np.where(lengths == 0, 1.0, lengths))


def best_hits(query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best documents of each query (rows of ``scores``), smaller id first on ties."""
    parts = []
    for i, q in enumerate(query_ids):
        order = np.lexsort((doc_ids, -scores[i]))[:k]
        parts.append(pd.DataFrame({"query_id": q, "doc_id": doc_ids[order], "score": scores[i][order]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def cosine_top_k(
    queries: DataFrame, docs: DataFrame, k: int, *, max_broadcast: int = BROADCAST_QUERIES, block: int = 20_000
) -> DataFrame:
    """``(query_id, doc_id, score, place)``: the ``k`` nearest documents of every query.

    Both sides are ``(id, embedding)``. A counted small set of queries is sent to the workers, the
    documents are read once, and every task returns only its best ``k`` per query. More queries than
    ``max_broadcast`` are cut, like the documents, into blocks that meet in bounded groups of many blocks.
    """
    few = queries.select("id", "embedding").limit(max_broadcast + 1).collect()
    if len(few) <= max_broadcast:
        hits = _by_broadcast(few, docs, k)
    else:
        hits = _by_blocks(queries, docs, k, max_broadcast, block)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def _by_broadcast(queries: list, docs: DataFrame, k: int) -> DataFrame:
    ids = np.array([q["id"] for q in queries], dtype=np.int64)
    vectors = unit_rows(np.array([q["embedding"] for q in queries], dtype=float)) if queries else None
    shared = docs.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_rows = shared.value
        best = None
        for batch in batches:
            if batch.empty or query_rows is None:
                continue
            scores = query_rows @ unit_rows(matrix(batch["embedding"]), 1e-12).T
            found = best_hits(query_ids, batch["id"].to_numpy(), scores, k)
            both = found if best is None else pd.concat([best, found])
            both = both.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True])
            best = both.groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return docs.select("id", "embedding").mapInPandas(search, HIT_SCHEMA)


def _by_blocks(queries: DataFrame, docs: DataFrame, k: int, query_block: int, doc_block: int) -> DataFrame:
    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    def numbered(df: DataFrame, name: str, own: int, other: str, others: int) -> DataFrame:
        return df.select(
            "id", "embedding",
            F.pmod(F.xxhash64("id"), F.lit(own)).alias(name),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other),
        )

    nq, nd = blocks(queries, GROUP_BLOCKS * query_block), blocks(docs, GROUP_BLOCKS * doc_block)
    left = numbered(queries, "qb", nq, "db", nd).groupBy("qb", "db")
    right = numbered(docs, "db", nd, "qb", nq).groupBy("qb", "db")

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        query_ids, query_rows = q["id"].to_numpy(), unit_rows(matrix(q["embedding"]))
        doc_ids, doc_rows = d["id"].to_numpy(), unit_rows(matrix(d["embedding"]), 1e-12)
        parts = []
        for i in range(0, len(q), query_block):
            rows = query_rows[i : i + query_block]
            # Hits carry the row of their query, as ids may stand twice, and are thinned block by block.
            best = (np.zeros(0, int), np.zeros(0, doc_ids.dtype), np.zeros(0))
            for j in range(0, len(d), doc_block):
                found = block_hits(doc_ids[j : j + doc_block], rows @ doc_rows[j : j + doc_block].T, k)
                best = first_hits(*(np.concatenate(pair) for pair in zip(best, found, strict=True)), k)
            parts.append(pd.DataFrame({"query_id": query_ids[i + best[0]], "doc_id": best[1], "score": best[2]}))
        return pd.concat(parts)

    return left.cogroup(right).applyInPandas(search, HIT_SCHEMA)


def block_hits(doc_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, doc_id, score)`` of all scores that can be among the ``k`` best of their row.

    Products of equal vectors can differ in the last digits by their place in the block; rounded ones are tied, and the smaller id wins.
    """
    scores = scores.round(12)
    if scores.shape[1] > k:
        least = np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]  # unknown scores sort last
        row, col = np.nonzero(~(-scores > least))
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
    return row, doc_ids[col], scores[row, col]


def first_hits(row: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best hits of every row, smaller id first on ties."""
    order = np.lexsort((doc, -score, row))
    row, doc, score = row[order], doc[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return row[place < k], doc[place < k], score[place < k]


def relative_scores(hits: DataFrame) -> DataFrame:
    """Adds ``relative``: scores of a query stretched to 0..1 over its hits, 1 if all are equal."""
    own = W.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    stretched = (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))
    return hits.withColumn("relative", F.coalesce(stretched, F.lit(1.0)))


def fit_text_embedder(texts: DataFrame, *, text: str = "text", dim: int = 384) -> Callable[[DataFrame], DataFrame]:
    """Default text embedding: hashed word counts with inverse document frequency, at length 1.

    Returns a function that adds ``embedding``. Any other function of that shape, such as one that
    applies a language model in a ``pandas_udf``, can take its place in the index.
    """
    tokens = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    known = texts.where(F.col(text).isNotNull())
    idf = IDF(inputCol="_counts", outputCol="_weights").fit(counts.transform(tokens.transform(known.select(text))))
    unit = Normalizer(inputCol="_weights", outputCol="_unit")

    def embed(df: DataFrame) -> DataFrame:
        rows = df.withColumn(text, F.coalesce(text, F.lit("")))
        vectors = unit.transform(idf.transform(counts.transform(tokens.transform(rows))))
        return vectors.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_weights", "_unit"
        )

    return embed


class SemanticIndex:
    """Records with their embeddings, ready to be searched or published."""

    def __init__(self, records: DataFrame, embed: Callable[[DataFrame], DataFrame], *, id_col: str, text: str):
        self.embed, self.id_col, self.text = embed, id_col, text
        self.table = embed(records)

    def search(self, queries: DataFrame, *, top_k: int = 5, digits: int = 6) -> DataFrame:
        """Records nearest to each ``(id, <text>)`` query, with the rounded score."""
        docs = self.table.select(F.col(self.id_col).cast("long").alias("id"), "embedding")
        asked = self.embed(queries).select(F.col("id").cast("long"), "embedding")
        hits = cosine_top_k(asked, docs, top_k).withColumn("score", F.bround("score", digits))
        hits = broadcast_if_small(hits)
        records = self.table.drop("embedding").withColumn("doc_id", F.col(self.id_col).cast("long"))
        return records.join(hits, "doc_id")

    def payload(self, queries: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """Record and query rows with rounded vectors, as published."""
        rounded = round_vector(F.col("embedding"), digits)
        return (
            self.table.withColumn("embedding", rounded),
            self.embed(queries).withColumn("embedding", rounded),
        )
