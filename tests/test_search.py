import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.operators import search


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def brute(queries, docs, k):
    out = set()
    for qi, q in queries:
        q = np.array(q, float) / (np.linalg.norm(q) or 1.0)
        scored = sorted((-float(np.dot(q, np.array(d, float) / max(np.linalg.norm(d), 1e-12))), i) for i, d in docs)
        out |= {(qi, i) for _, i in scored[:k]}
    return out


def pairs(hits):
    return {(r["query_id"], r["doc_id"]) for r in hits.collect()}


def test_small_fixture(spark):
    docs = vectors(spark, [(0, [1, 0, 0]), (1, [0, 1, 0]), (2, [0.9, 0.1, 0])])
    hits = search.cosine_top_k(vectors(spark, [(7, [1, 0, 0])]), docs, 2).orderBy("place").collect()
    assert [(r["query_id"], r["doc_id"], r["place"]) for r in hits] == [(7, 0, 1), (7, 2, 2)]
    assert hits[0]["score"] == pytest.approx(1.0)


def test_k_is_limited_by_the_documents_and_zero_query_works(spark):
    docs = vectors(spark, [(0, [1, 0]), (1, [0, 0])])
    hits = search.cosine_top_k(vectors(spark, [(0, [0, 0])]), docs, 10).orderBy("place").collect()
    assert [(r["doc_id"], r["score"]) for r in hits] == [(0, 0.0), (1, 0.0)]


@pytest.mark.parametrize("max_broadcast", [1000, 4])
def test_both_ways_equal_brute_force(spark, max_broadcast):
    rng = np.random.default_rng(0)
    docs = [(i, rng.normal(size=8)) for i in range(150)]
    queries = [(i, rng.normal(size=8)) for i in range(9)]
    hits = search.cosine_top_k(
        vectors(spark, queries), vectors(spark, docs).repartition(5), 6, max_broadcast=max_broadcast, block=40
    )
    assert pairs(hits) == brute(queries, docs, 6)


def test_no_documents(spark):
    empty = vectors(spark, [])
    assert search.cosine_top_k(vectors(spark, [(0, [1.0])]), empty, 3).isEmpty()


def test_relative_scores(spark):
    hits = spark.createDataFrame([(1, 0.2), (1, 0.6), (1, 1.0), (2, 0.5), (2, 0.5)], "query_id long, score double")
    got = sorted((r["query_id"], r["score"], r["relative"]) for r in search.relative_scores(hits).collect())
    assert [g[2] for g in got] == pytest.approx([0.0, 0.5, 1.0, 1.0, 1.0])


def test_text_index_finds_the_matching_record(spark):
    texts = ["extreme heat in the desert", "freezing winter cold", "mild spring day", None]
    records = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = search.SemanticIndex(records, search.fit_text_embedder(records), id_col="doc_id", text="text")
    queries = spark.createDataFrame([(1, "desert heat"), (2, "cold winter")], "id long, text string")
    best = {r["query_id"]: r["doc_id"] for r in index.search(queries, top_k=1).collect()}
    assert best == {1: 0, 2: 1}
    docs, asked = index.payload(queries)
    assert docs.count() == 4 and len(asked.first()["embedding"]) == 384
    lengths = docs.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert [r[0] for r in lengths[:3]] == pytest.approx([1.0] * 3, abs=1e-4)


def test_text_scores_equal_brute_force(spark):
    texts = ["a b c", "b c d", "c d e e", "x y"]
    records = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    embed = search.fit_text_embedder(records, dim=64)
    rows = embed(records).collect()
    index = search.SemanticIndex(records, embed, id_col="doc_id", text="text")
    hits = index.search(records.select(F.col("doc_id").alias("id"), "text"), top_k=4, digits=9).collect()
    e = {r["doc_id"]: np.array(r["embedding"], float) for r in rows}
    for h in hits:
        a, b = e[h["query_id"]], e[h["doc_id"]]
        assert h["score"] == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=1e-8)


def test_blocks_with_many_ties_equal_brute_force_and_travel_in_groups(spark):
    rng = np.random.default_rng(3)
    table = np.repeat(rng.normal(size=(60, 8)), 5, axis=0).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), table, strict=True)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    got = search.cosine_top_k(docs, docs, 3, max_broadcast=16, block=32).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for q in unit:
        best = sorted((-round(float(unit[q] @ unit[d]), 9), d) for d in unit)[:3]
        assert sorted((r.place, r.doc_id) for r in got if r.query_id == q) == [(p + 1, d) for p, (_, d) in enumerate(best)]
    # 300 vectors fit in one group of either side, so each travels once.
    plan = search._by_blocks(docs, docs, 3, 16, 32)._jdf.queryExecution().analyzed().toString()
    assert plan.count("sequence(cast(0 as bigint), cast(0 as bigint)") == 2
