import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.llm import mixing
from tests.llm.conftest import sentence

A = [a + b + c for a in "bdfgklm" for b in "ae" for c in ("n", "r", "st")]
B = [a + b + c for a in "prtvwz" for b in "ou" for c in ("x", "ll", "m")]


def corpus(llm, rng, n=400):
    docs = [(i, sentence(rng, rng.randint(20, 60), B if i % 4 == 0 else A)) for i in range(n)]
    labels = [(i, "b" if i % 4 == 0 else "a") for i in range(0, n, 3)]
    return llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, domain string")


def shared_table(llm, seed=1, n=500, d=3):
    rng = np.random.default_rng(seed)
    p, tokens = rng.dirichlet(np.full(d, 0.4), n), rng.integers(0, 900, n)
    rows = [(int(t), [float(x) for x in v]) for t, v in zip(tokens, p, strict=True)]
    return llm.createDataFrame(rows, "tokens long, posterior array<double>"), p, tokens


def brute(p, tokens, steps):
    """The same projected steps, document by document in numpy."""
    r = np.ones(len(tokens))
    for g in steps:
        r = np.maximum(0, r - p @ g)
    return r


@pytest.mark.parametrize("targets", [[1, 1, 1], [0.7, 0.2, 0.1], [1, 0, 2]])
def test_totals_meet_targets(llm, targets):
    shared, p, tokens = shared_table(llm)
    steps, wanted, now = mixing.fit_rates(shared, targets)
    rates = brute(p, tokens, steps)
    assert (rates >= 0).all() and (rates * tokens) @ p == pytest.approx(now)
    assert wanted == pytest.approx(np.array(targets) / sum(targets) * tokens.sum())
    # Least squares: at the optimum no document's rate can improve the distance, unless it is zero already.
    plain = np.linalg.norm(tokens @ p - wanted)
    assert np.linalg.norm(now - wanted) <= (1e-3 * wanted.sum() if 0 not in targets else 0.5 * plain)


def test_anchor_keeps_its_tokens(llm):
    shared, p, tokens = shared_table(llm, seed=2)
    _, wanted, _ = mixing.fit_rates(shared, [0.8, 0.1, 0.1], anchor=0)
    assert wanted[0] == pytest.approx((tokens @ p)[0])


def test_domains_are_learned_and_mixed(llm, rng):
    docs, labels = corpus(llm, rng)
    rows = mixing.mixed(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    assert all(sum(r.posterior) == pytest.approx(1) and r.rate >= 0 for r in rows)
    right = sum((r.posterior[1] > 0.5) == (r.doc_id % 4 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    total = [sum(r.rate * r.tokens * r.posterior[j] for r in rows) for j in (0, 1)]
    assert total[0] == pytest.approx(total[1], rel=0.02) and sum(total) == pytest.approx(sum(r.tokens for r in rows), rel=0.02)


def test_thinning_keeps_the_anchor(llm, rng):
    docs, labels = corpus(llm, rng)
    kept = {r.doc_id for r in mixing.mixed_once(docs.repartition(3), labels, {"a": 0.95, "b": 0.05}, anchor="a").collect()}
    assert kept == {r.doc_id for r in mixing.mixed_once(docs, labels, {"a": 0.95, "b": 0.05}, anchor="a").collect()}
    a, b = (sum((i % 4 == 0) == t for i in kept) for t in (False, True))
    assert a >= 297 and 5 <= b <= 35


def test_odd_rows(odd, none, clashing, llm, rng):
    docs, labels = corpus(llm, rng, 60)
    targets = {"a": 0.5, "b": 0.5}
    assert mixing.mixed(odd, labels, targets).count() == odd.count()
    assert mixing.mixed(none, labels, targets).count() == 0
    assert mixing.mixed_once(none, labels, targets, anchor="a").count() == 0
    rated = mixing.mixed(clashing, labels, targets)
    assert rated.columns == [c for c in clashing.columns if c not in ("tokens", "posterior", "rate")] + ["tokens", "posterior", "rate"]
    assert mixing.mixed_once(clashing, labels, targets, anchor="a").columns == clashing.columns
    unlabelled = mixing.mixed(docs, labels.limit(0), targets)
    assert {tuple(r.posterior) for r in unlabelled.collect()} == {(0.5, 0.5)}
    again = labels.union(labels).union(llm.createDataFrame([(None, "a"), (1, None), (2, "other")], labels.schema))
    assert mixing.mixed(docs.where(F.col("doc_id") < 30), again, targets).count() == 30
    with pytest.raises(ValueError):
        mixing.mixed(docs, labels, {"a": 0.0, "b": 0.0})


def test_labels_of_no_document_give_even_shares(llm):
    docs = llm.createDataFrame([(1, "one text"), (2, "another")], "doc_id long, text string")
    labelled = llm.createDataFrame([(77, "good"), (78, "low")], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labelled, ["good", "low"])
    assert not model["weights"].any()
