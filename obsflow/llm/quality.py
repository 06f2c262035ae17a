"""Quality rules as a short-circuit cascade. DataFrame and SQL functions only.

Rules are SQL conditions on ``text`` and the counts of a document that reject it. On a sample, drawn by the hash of ``doc_id``, the characters that
a rule goes through are counted, which is its cost, and the share of rows it rejects, its selectivity. Both are counts, so every run gives one order.
Rules then run in the order of rejections per character as branches of one CASE, which evaluates a branch only for rows that no earlier
one has rejected. The order changes the time, never the verdict. A rule that gives null doesn't reject.

A null text counts as an empty one, which the base refuses; a null id is kept, repeated rows are judged one by one, and an empty table gives an empty one.
Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.session import checkpointed

# Fixed values of the contract: white space, symbols, limits.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEATED_PERCENT = 50, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A condition, and how many characters it goes through: the text's, unless ``reads`` says otherwise (a count stands for one)."""

    name: str
    rejects: Column
    reads: Column = field(default_factory=lambda: F.length("text"))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_list(text: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def word_chars(text: Column) -> Column:
    return F.length(without(text, SPACES)).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(without(text, SYMBOLS))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word in them."""
    return F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return repeated(lines(text))


def repeated(kept: Column) -> Column:
    return (F.size(kept) - F.size(F.array_distinct(kept))).cast("long")


def windows(words: Column) -> Column:
    """``(hash, position)`` of every three-word window, sorted; 64-bit hashes stand for the words."""
    full = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    hashed = F.transform(full, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(hashed)


def repeated_words(sorted_windows: Column) -> Column:
    """Words covered by windows whose hash a neighbour in the sorted list shares."""
    again = F.filter(
        sorted_windows,
        lambda x, j: F.coalesce(x["h"] == F.get(sorted_windows, j + 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(sorted_windows, j - 1)["h"], F.lit(False)),
    )
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, the base counts of every text and ``n_lines``; a null text has none of anything."""
    t = F.col("text")
    split = docs.select("doc_id", F.coalesce(t, F.lit("")).alias("text")).withColumns({"_words": word_list(t), "_lines": lines(t)})
    sorted_once = split.withColumn("_windows", windows(F.col("_words")))
    counted = sorted_once.select(
        "doc_id", "text", F.size("_words").cast("long").alias("n_words"), word_chars(t).alias("word_chars"), symbols(t).alias("n_symbols"),
        repeated(F.col("_lines")).alias("n_dup_lines"), repeated_words(F.col("_windows")).alias("n_repeat_words"), F.size("_lines").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def default_rules() -> list[Rule]:
    """Rules on the text alone: symbols, shouting, repeated lines, odd word lengths."""
    t = F.col("text")
    upper = F.length(t) - F.length(without(t, UPPER))
    lower = F.length(t) - F.length(without(t, LOWER))
    words = F.size(word_list(t))
    return [
        Rule("symbols", 4 * symbols(t) > words),
        Rule("shouting", (upper > lower) & (upper > 20)),
        Rule("duplicate_lines", 2 * duplicate_lines(t) > F.size(lines(t))),
        Rule("word_length", (word_chars(t) < 2 * words) | (word_chars(t) > 15 * words)),
    ]


def counted_rules() -> list[Rule]:
    """The default rules on measured documents: what is counted already is not counted again."""
    t, one = F.col("text"), F.lit(1)
    upper, lower = (F.length(t) - F.length(without(t, letters)) for letters in (UPPER, LOWER))
    return [
        Rule("symbols", 4 * F.col("n_symbols") > F.col("n_words"), one),
        Rule("shouting", (upper > lower) & (upper > 20), 2 * F.length(t)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines"), one),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")), one),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts, by the hash of their ids, stored once."""
    total = docs.select(F.count(F.lit(1))).first()[0]
    share = min(1.0, rows / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    return checkpointed(docs.where(draw).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """``(rule, characters, rejected share)`` by falling rejection per cost, both means over the sample; ties keep the given order."""
    share = [F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"s{i}") for i, r in enumerate(rules)]
    cost = [F.avg(r.reads.cast("double")).alias(f"c{i}") for i, r in enumerate(rules)]
    row = sample.agg(*share, *cost).first()
    found = [(r, max(row[f"c{i}"] or 0.0, 1.0), row[f"s{i}"] or 0.0) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null for documents that pass all."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base counts of every document and ``kept``: base passed and no rule of the ordered cascade rejects."""
    rules = counted_rules() if rules is None else rules
    ordered = [rule for rule, _, _ in order_rules(measured(sampled(docs)), rules)] if rules else []
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered).isNull())
    return measured(docs).withColumn("kept", verdict).drop("text", "n_lines")
