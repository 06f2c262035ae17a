import random

import pytest

from obsflow.session import ship

ODD = [
    (1, "one two three four five six seven", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "a row without an id", "en", "b", 5),
    (None, None, None, None, None),
    (4, " \n\t ", "de", "b", 4),
    (5, "12345 !!! ???", "de", "b", 4),
    (6, "same text in two rows", "en", "c", 1),
    (6, "same text in two rows", "en", "c", 1),
    (7, "same text in two rows", "en", "c", 1),
    (8, "é ü 日本語 😀 ß" * 3, "fr", "c", 1),
    (9, "word " * 40_000, "en", "c", 1),
    (10, "x" * 150_000, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture
def odd(llm):
    """Nulls, empty, blank, repeated and very long texts."""
    return llm.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(odd):
    """Extra columns with the names that operators make."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "grown_shard", "size", "rate", "tokens", "posterior", "score", "predicted", "lang_pred", "lang_score", "lang_rejected", "row", "node", "seed", "component_id", "kept", "n_words", "spans"]
    return odd.withColumns({n: F.lit("x") for n in names})


def sentence(rng, words, vocabulary=None):
    vocabulary = vocabulary or [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo", "mi")]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture
def rng():
    return random.Random(5)
