from pyspark.sql import functions as F

from obsflow.llm import language
from tests.llm.conftest import sentence

A = [a + b + c for a in "bdfgklm" for b in "ae" for c in ("n", "r", "st")]
B = [a + b + c for a in "prtvwz" for b in "ou" for c in ("x", "ll", "é")]


def corpus(llm, rng, n=240):
    rows = [(i, sentence(rng, rng.randint(20, 60), (A, B)[i % 2]), ("aa", "bb")[i % 2]) for i in range(n)]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(llm, rng):
    docs = corpus(llm, rng)
    held = F.col("doc_id") % 3 == 0
    model = language.fit_language(docs, held, per_language=200)
    assert model["languages"] == ["aa", "bb"]
    rows = language.identify(docs, model).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_labels_are_no_input_and_model_repeats(llm, rng):
    docs = corpus(llm, rng, 60)
    one, two = (language.fit_language(d, F.lit(False)) for d in (docs, docs.repartition(5)))
    assert (one["table"] == two["table"]).all()
    swapped = docs.withColumn("lang", F.lit("bb"))
    pick = ["doc_id", "lang_pred", "lang_score"]
    assert sorted(language.identify(docs, one).select(pick).collect()) == sorted(language.identify(swapped, one).select(pick).collect())


def test_rejection(llm, rng):
    mixed = [(1000 + i, sentence(rng, 30, A + B), ("aa", "bb")[i % 2]) for i in range(120)]
    docs = corpus(llm, rng).union(llm.createDataFrame(mixed, "doc_id long, text string, lang string"))
    model = language.fit_language(docs, F.lit(False), per_language=1000)
    assert model["threshold"] > 0.5
    rows = language.identify(docs, model).collect()
    share = {new: sum(r.lang_rejected for r in rows if (r.doc_id >= 1000) == new) / sum((r.doc_id >= 1000) == new for r in rows) for new in (True, False)}
    assert share[True] > 0.5 > 0.05 > share[False]


def test_odd_rows(odd, clashing, none, llm, rng):
    model = language.fit_language(corpus(llm, rng, 40), F.lit(False))
    out = language.identify(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score", "lang_rejected"] and out.count() == odd.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert letters or (r.lang_score == 0 and r.lang_rejected)
    again = language.identify(clashing, model)
    assert len(set(again.columns)) == len(again.columns) and dict(again.dtypes)["lang_score"] == "double"
    assert language.identify(none, model).count() == 0
    assert language.fit_language(none, F.lit(False))["languages"] == ["und"]
    assert language.fit_language(odd, F.lit(False))["languages"] == ["en", "fr"]


def test_rows_without_an_id_are_drawn(llm, rng):
    rows = [(None, sentence(rng, 12, ["der", "und", "nicht", "haus"]) if i % 2 else sentence(rng, 12, ["the", "and", "house", "not"]), "de" if i % 2 else "en") for i in range(1200)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(False), per_language=200)
    got = language.identify(docs, model).where("lang_pred = lang").count()
    assert got > 1150


def test_nothing_drawn_gives_a_model(llm, monkeypatch):
    docs = llm.createDataFrame([(1, "der hund", "de")] * 50, "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(False), per_language=0)
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
