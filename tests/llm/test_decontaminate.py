import numpy as np
import pyarrow as pa
import pytest

from obsflow.llm import decontaminate
from tests.llm.conftest import sentence


@pytest.fixture
def items(llm, rng):
    texts = [sentence(rng, n) + ". " + sentence(rng, 6) + "." for n in (18, 30, 40, 55, 70, 160)]
    return llm.createDataFrame(list(enumerate(texts)), "item_id long, text string"), texts


def test_leading_vectors_equal_numpy(llm):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((40, 25)) * np.geomspace(1, 1e-3, 25)
    rows = [(list(range(25)), [float(v) for v in r]) for r in dense]
    found = decontaminate.leading_vectors(llm.createDataFrame(rows, "place array<int>, value array<double>").repartition(3), 25, 40, 5)
    _, _, want = np.linalg.svd(dense)
    assert np.abs(found.T @ want[:5].T).diagonal() == pytest.approx(np.ones(5), abs=1e-4)


def test_exact_and_edited_items_are_found_clean_documents_are_not(llm, rng, items):
    benchmark, texts = items
    rows, want = [], set()
    for i, text in enumerate(texts):
        rows.append((2 * i, sentence(rng, 120) + " " + text + " " + sentence(rng, 90)))
        words = text.split()
        words[3], words[8] = "other", "words"
        rows.append((2 * i + 1, sentence(rng, 60) + " " + " ".join(words).upper() + " " + sentence(rng, 200)))
        want |= {(2 * i, i), (2 * i + 1, i)}
    rows += [(100 + i, sentence(rng, 300)) for i in range(60)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, benchmark).collect()) == list(range(100, 160))


def test_blocks_of_items_give_the_same(llm, rng, items, monkeypatch):
    benchmark, texts = items
    docs = llm.createDataFrame([(i, sentence(rng, 50) + " " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == one == {(i, i) for i in range(6)}


def test_odd_rows(odd, none, clashing, llm, items):
    benchmark, texts = items
    assert decontaminate.contaminated(odd, benchmark).count() == 0
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0
    kept = decontaminate.without_contaminated(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == odd.count()
    strange = benchmark.union(llm.createDataFrame([(None, texts[0]), (8, None), (9, ""), (10, "too short")], benchmark.schema))
    assert decontaminate.without_contaminated(odd, strange).count() == odd.count()
    null_id = llm.createDataFrame([(None, texts[2]), (None, "a clean one")], "doc_id long, text string")
    assert [r.text for r in decontaminate.without_contaminated(null_id, strange).collect()] == ["a clean one"]


def test_memory_of_a_search_does_not_grow_with_the_units(rng):
    import tracemalloc

    from obsflow.llm.text import pieces

    vocabulary, units = decontaminate.cut_units([(i, sentence(rng, 20)) for i in range(2000)])
    search = decontaminate.Searcher(vocabulary, units, np.random.default_rng(4).standard_normal((len(vocabulary.hashes), 32)))
    column = pa.array([sentence(rng, 2000) for _ in range(40)])
    tracemalloc.start()
    try:
        for _, _, data, offsets in pieces(column, decontaminate.PIECE):
            search(data, offsets)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
