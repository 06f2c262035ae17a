"""Cosine and text search on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.functions import scalar
from obsflow.operators import search
from obsflow.operators.joins import lookup
from obsflow.plans.catalog import Tables, query, r6
from obsflow.session import spread


def documents(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def centroids(t: Tables) -> DataFrame:
    """Query vectors: the mean vector of every label, worked out over all vectors."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(ordered, lambda s: s["m"]).alias("embedding"))


CENTROIDS = """cells AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
  means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2),
  q AS (SELECT label AS query_id, list(m ORDER BY pos) AS v FROM means GROUP BY 1),
  d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  sims AS (SELECT query_id, vec_id AS doc_id, list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS score FROM q, d),
  hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sims QUALIFY place <= 5)"""


@query(
    "cosine_topk",
    f"WITH {CENTROIDS} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM hits",
)
def cosine_topk(t: Tables):
    return search.cosine_top_k(centroids(t), documents(t), 5).select("query_id", "doc_id", r6("score"), "place")


@query(
    "relative_score",
    f"""WITH {CENTROIDS} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(coalesce((score - min(score) OVER p)
      / nullif(max(score) OVER p - min(score) OVER p, 0), 1.0), 6) AS relative FROM hits WINDOW p AS (PARTITION BY query_id)""",
)
def relative_score(t: Tables):
    hits = search.relative_scores(search.cosine_top_k(centroids(t), documents(t), 5))
    return hits.select("query_id", "doc_id", r6("relative"))


NEIGHBOURS = """d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM d),
  sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM u a, u b)"""


@query(
    "all_neighbours",
    f"""WITH {NEIGHBOURS} SELECT query_id, doc_id, round(score, 6) AS score FROM sims
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 4""",
)
def all_neighbours(t: Tables):
    # Every vector is a query: their number grows with the table, so blocks of both sides meet.
    hits = search.cosine_top_k(documents(t), documents(t), 4, max_broadcast=256, block=1024)
    return hits.select("query_id", "doc_id", r6("score"))


@query(
    "cosine_pairs",
    f"""WITH {CENTROIDS} SELECT vec_id, round(list_dot_product(v, e), 6) AS dot, round(sqrt(list_dot_product(e, e)), 6) AS norm,
      round(list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))), 6) AS cosine
    FROM d JOIN embeddings USING (vec_id) JOIN q ON label = query_id""",
)
def cosine_pairs(t: Tables):
    # Every vector with the mean vector of its label: one small row per label is looked up.
    means = centroids(t).select(F.col("id").cast("int").alias("label"), F.col("embedding").alias("mean"))
    pairs = lookup(t.embeddings, means, ["label"], keep_missing=False)
    a, b = F.col("mean"), F.col("embedding")
    return pairs.select("vec_id", r6(scalar.dot(a, b), "dot"), r6(scalar.norm(b), "norm"), r6(scalar.cosine(a, b), "cosine"))


@query(
    "index_search",
    f"""WITH {CENTROIDS} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, label, round(score, 5) AS score FROM hits JOIN embeddings ON doc_id = vec_id""",
)
def index_search(t: Tables):
    # The vectors are stored with the records, so embedding them is a plain projection here.
    index = search.SemanticIndex(t.embeddings.select("vec_id", "label", "embedding"), lambda df: df, id_col="vec_id", text="label")
    return index.search(centroids(t), top_k=5, digits=9).select("query_id", "doc_id", "label", r6("score", digits=5))


@query(
    "rounded_vectors",
    """
    WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT vec_id, count(*) AS dim, round(sum(round(x, 6)), 6) AS total FROM c GROUP BY 1
    """,
)
def rounded_vectors(t: Tables):
    rounded = t.embeddings.select("vec_id", scalar.round_vector(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rounded.select("vec_id", F.size("v").cast("long").alias("dim"), r6(total, "total"))


@query("text_search")
def text_search(t: Tables):
    docs = spread(t.documents.select("doc_id", "text"))
    embed = search.fit_text_embedder(docs)
    index = search.SemanticIndex(docs, embed, id_col="doc_id", text="text")
    hits = index.search(t.benchmark.select(F.col("item_id").alias("id"), "text"), top_k=5)
    return hits.select("query_id", "doc_id", "score", "place")
