"""The stages against plain Python on a small corpus with planted cases."""

import re

import pytest

import corpus_pipeline
from tests.llm.conftest import sentence
from tests.llm.test_jaccard import brute

A = [a + b + c for a in "bdfgklm" for b in "ae" for c in ("n", "r", "st", "lo")]
B = [a + b + c for a in "prtvwz" for b in "ou" for c in ("x", "ll", "m", "si")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(llm, rng, tmp_path):
    items = [sentence(rng, 40, (A, B)[i % 2]) + "." for i in range(4)]
    rows = [(i, sentence(rng, rng.randint(60, 120), (A, B)[i % 2]), ("aa", "bb")[i % 2]) for i in range(160)]
    base = [r[1] for r in rows]
    rows += [(200 + i, base[i] + " end", rows[i][2]) for i in range(6)]  # near copies
    rows += [(210 + i, base[7], rows[7][2]) for i in range(9)]  # exact copies
    rows += [(300 + i, sentence(rng, 60, (A, B)[i % 2]) + " " + t, ("aa", "bb")[i % 2]) for i, t in enumerate(items)]  # contaminated
    rows += [(400, None, None), (401, "", None), (402, "123 456 !!", "aa"), (403, " \n ", "bb"), (None, base[3], "bb")]
    rng.shuffle(rows)
    docs = [(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows]
    llm.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([(i, "b", t) for i, t in enumerate(items)], "item_id long, benchmark string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, 1, 0) for i in range(0, 160, 2)]
    llm.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, items


def test_run_equals_plain_python(llm, folder):
    at, docs, items = folder
    rows = [(i, t) for i, t, *_ in docs if t and re.search("[a-z]", t)]
    least = {}
    for i, size, c in brute(rows):
        least[i] = c
    rows = [(i, t) for i, t in rows if i is None or least[i] == i]
    want = {i for i, t in rows if not any(x in t for x in items)}
    out = corpus_pipeline.run(llm, at)
    found = out.collect()
    assert out.columns[:1] == ["shard"] or {"shard", "slot", "grown_shard"} < set(out.columns)
    got = {r.doc_id for r in found}
    # All labelled documents are good ones, so mixing has nothing to thin out. Few clean ones may fall below the language threshold.
    assert got <= want and len(want - got) <= 0.05 * len(want)
    slots = sorted((r.shard, r.slot) for r in found)
    assert all(0 <= s < corpus_pipeline.SHARDS for s, _ in slots)
    sizes = {s: sum(x == s for x, _ in slots) for s, _ in slots}
    assert slots == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    assert all(r.grown_shard in (r.shard, corpus_pipeline.SHARDS) for r in found)


def test_stages_keep_the_columns(llm, folder):
    at, _, _ = folder
    docs = llm.read.parquet(f"{at}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "target_mixture", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm, docs, at).columns == docs.columns
        assert stage(llm, docs.limit(0), at).count() == 0
    assert set(docs.columns) < set(corpus_pipeline.STAGES[-1][1](llm, docs.limit(0), at).columns)
