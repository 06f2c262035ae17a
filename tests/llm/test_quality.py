import re
from collections import Counter

from pyspark.sql import functions as F

from obsflow.llm import quality
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_base_counts(llm, odd, rng):
    texts = [" ".join(rng.choice(["a", "b", "c#", "d|d", "\n", "x y\nx y\n", "é", "\x0b", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = odd.select("doc_id", "text").union(llm.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in docs.collect())


def test_junk_goes_and_clean_stays(llm, rng):
    clean = sentence(rng, 120)
    junk = [" | ".join(sentence(rng, 80).split()), " ".join(w + "$$$" for w in sentence(rng, 80).split()), (clean + "!!").upper(), (sentence(rng, 20) + "\n") * 6]
    docs = llm.createDataFrame([(0, clean), (1, clean + "\n" + sentence(rng, 9)), *enumerate(junk, 2)], "doc_id long, text string")
    assert {r.doc_id for r in quality.judged(docs).where("kept").collect()} == {0, 1}


def test_order_changes_no_verdict(llm, rng):
    docs = llm.createDataFrame([(i, sentence(rng, 60) + "#" * rng.randint(0, 60)) for i in range(40)], "doc_id long, text string")
    rules = quality.default_rules()
    one = docs.select("doc_id", quality.cascade(rules).isNull().alias("k")).collect()
    other = docs.select("doc_id", quality.cascade(rules[::-1]).isNull().alias("k")).collect()
    assert sorted(one) == sorted(other) and 0 < sum(r.k for r in one) < 40


def test_rules_are_ordered_by_rejection_per_cost(llm, rng):
    docs = llm.createDataFrame([(i, sentence(rng, 400)) for i in range(300)], "doc_id long, text string")
    never = quality.Rule("never", quality.duplicate_lines(F.col("text")) > 100)
    cheap = quality.Rule("cheap", F.col("text").isNotNull())
    assert [r.name for r, _, _ in quality.order_rules(quality.sampled(docs), [never, cheap])] == ["cheap", "never"]


def test_empty_and_clashing(none, clashing):
    assert quality.judged(none).count() == 0 and quality.judged(none, []).count() == 0
    assert quality.judged(clashing).count() == clashing.count()


def test_order_is_the_same_in_ten_runs(llm, rng):
    docs = llm.createDataFrame([(i, sentence(rng, 60) + ("#" * 40 if i % 3 else "") + ("\nsame line" * (i % 50))) for i in range(300)], "doc_id long, text string")
    sample = quality.measured(quality.sampled(docs))
    orders = {tuple(r.name for r, _, _ in quality.order_rules(sample.repartition(1 + k % 4), quality.counted_rules())) for k in range(10)}
    assert len(orders) == 1


def test_counted_rules_judge_like_those_on_the_text(llm, odd, rng):
    texts = [sentence(rng, rng.randint(1, 90)) + rng.choice(["", "#" * 30, "\nx" * 40, " i i i" * 60, "AB CD" * 40]) for _ in range(150)]
    docs = odd.select("doc_id", "text").union(llm.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = quality.measured(docs).select(*[F.coalesce(r.rejects, F.lit(False)).alias(f"{k}{r.name}") for k, rules in enumerate((quality.default_rules(), quality.counted_rules())) for r in rules]).collect()
    assert all(r[f"0{x.name}"] == r[f"1{x.name}"] for r in rows for x in quality.default_rules())
    assert all(any(r[f"0{x.name}"] for r in rows) for x in quality.default_rules())
