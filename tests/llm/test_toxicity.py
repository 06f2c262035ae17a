from pyspark.sql import functions as F

from obsflow.llm import toxicity
from tests.llm.conftest import sentence

BAD = ["grr", "zap", "vex", "snarl", "hiss"]
LABELS = "doc_id long, toxic int"


def corpus(llm, rng, n=1500):
    """Every fifth text is toxic; a third of all texts is labelled."""
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, 60).split()
        if i % 5 == 0:
            for _ in range(8):
                words[rng.randrange(60)] = rng.choice(BAD)
        docs.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, int(i % 5 == 0)))
    return llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, LABELS)


def test_held_out_ranking_and_verdict(llm, rng):
    docs, labels = corpus(llm, rng)
    held = F.col("doc_id") % 4 == 1
    model = toxicity.fit_toxicity(docs, labels, held)
    assert 0.1 < model["prior"] < 0.3
    rows = toxicity.score_toxicity(docs, model, ["doc_id"]).where(held).collect()
    bad, good = ([r for r in rows if (r.doc_id % 5 == 0) == b] for b in (True, False))
    ahead = sum(x.score > y.score for x in bad for y in good) / (len(bad) * len(good))
    assert ahead > 0.97
    assert sum(r.predicted for r in bad) > 0.8 * len(bad) and sum(r.predicted for r in good) < 0.05 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_are_not_read(llm, rng):
    docs, labels = corpus(llm, rng, 300)
    held = F.col("doc_id") % 2 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit_toxicity(docs.repartition(n), x, held) for n, x in ((1, labels), (5, turned)))
    assert (one["weights"] == two["weights"]).all() and one["bias"] == two["bias"]


def test_odd_rows(odd, none, clashing, llm, rng):
    docs, labels = corpus(llm, rng, 60)
    model = toxicity.fit_toxicity(docs, labels, F.lit(False))
    rows = toxicity.score_toxicity(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(none, model, ["doc_id"]).count() == 0
    assert toxicity.score_toxicity(clashing, model, ["doc_id"]).count() == odd.count()
    no_labels = llm.createDataFrame([], LABELS)
    unfit = toxicity.fit_toxicity(odd, no_labels, F.lit(False))
    assert {r.predicted for r in toxicity.score_toxicity(odd, unfit, ["doc_id"]).collect()} == {0}
    repeated = labels.union(labels).union(llm.createDataFrame([(None, 1), (0, None)], LABELS))
    again = toxicity.fit_toxicity(docs, repeated, F.lit(False))
    assert (again["weights"] != 0).any()


def test_labels_without_documents(llm, none):
    labels = llm.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(none, labels, F.lit(False))
    assert toxicity.score_toxicity(none, model, ["doc_id"]).collect() == []
