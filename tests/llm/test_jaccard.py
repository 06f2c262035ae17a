import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsflow.llm import jaccard
from obsflow.llm.components import connected
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = sentence(rng, 1)
    return out


def test_signatures_lose_no_similar_pair():
    rng, bands, seen = np.random.default_rng(1), jaccard.Bands(), 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 16, 30, 70, 300]))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[rng.integers(0, n // 4 + 1) :], rng.integers(0, 1 << 62, rng.integers(0, n // 4 + 1)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            sig, owner = jaccard.signatures([a, b], bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1])
            seen += 1
    assert seen > 500


def test_components_equal_brute_force(llm, odd, rng):
    rows = []
    for g in range(25):
        words = sentence(rng, rng.choice([3, 5, 6, 8, 12, 30, 90, 200])).split()
        for _ in range(rng.randint(1, 7)):  # chains of ever more edited copies
            rows.append((len(rows) * 7 + 50, " ".join(words)))
            words = edited(rng, words, rng.choice([0, 0, 1, 1, 2])) + sentence(rng, rng.randint(0, 2)).split()
    rng.shuffle(rows)
    docs = odd.select("doc_id", "text").union(llm.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs.repartition(5)).collect())
    assert got == brute([tuple(r) for r in docs.collect()])


def test_hot_group_and_salt(llm, rng, monkeypatch):
    words = sentence(rng, 80).split()
    rows = [(i, " ".join(edited(rng, words, 1)) if i % 3 else sentence(rng, 80)) for i in range(240)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert jaccard.hot_signatures(docs, 5, 80, 0).count() > 0
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_one_document_of_each_group_stays(llm, odd, clashing, none, rng):
    text = sentence(rng, 60)
    docs = llm.createDataFrame([(5, text), (3, text + " end"), (9, sentence(rng, 60)), (4, ""), (8, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [3, 4, 8, 9]
    kept = jaccard.one_of_each(odd).collect()
    assert sum(r.doc_id == 6 for r in kept) == 1 and not any(r.doc_id == 7 for r in kept) and sum(r.doc_id is None for r in kept) == 2
    assert jaccard.one_of_each(clashing).columns == clashing.columns
    assert jaccard.one_of_each(none).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(7, 3), (3, 7), (9, 8), (8, 2)]])
def test_connected(llm, edges):
    links = llm.createDataFrame(edges, "a long, b long")
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert {r.node: r.component for r in connected(links).collect()} == part
    assert connected(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).count() == len(part)


def test_words_made_to_share_a_polynomial_hash(llm):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{word} b c d e"), (2, f"{other} b c d e"), (3, f"{other} b c d e")]
    found = jaccard.jaccard_components(llm.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 2}


def test_rarest_signatures_lose_no_similar_pair():
    rng, bands, seen, kept, whole = np.random.default_rng(2), jaccard.Bands(), 0, 0, 0
    common = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for _ in range(1500):
        n = int(rng.choice([2, 5, 8, 16, 45, 50, 59, 60, 70, 235, 300]))
        a = np.concatenate([rng.choice(common, n // 2, replace=False), rng.integers(0, 1 << 62, n - n // 2).astype(np.uint64)])
        b = np.concatenate([a[rng.integers(0, n // 6 + 1) :], rng.integers(0, 1 << 62, rng.integers(0, n // 6 + 1)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            every, owner = jaccard.signatures([a, b], bands, frequent=None)
            both = np.intersect1d(every[owner == 0], every[owner == 1])
            known = np.unique(np.concatenate([rng.choice(both, len(both) // 2, replace=False), rng.choice(every, len(every) // 4)]))
            sig, where = jaccard.signatures([a, b], bands, frequent=(known, rng.integers(3, 300, len(known))))
            assert set(sig[where == 0]) & set(sig[where == 1])
            seen, kept, whole = seen + 1, kept + len(sig), whole + len(every)
    assert seen > 300 and kept < 0.7 * whole


def test_a_common_passage_makes_few_buckets(llm, rng):
    passage = sentence(rng, 60)
    rows = [(i, f"{passage} {sentence(rng, 70)}" if i % 2 else sentence(rng, 130)) for i in range(400)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert jaccard.bucket_table(docs, 5, 80, 0).count() < 100


def test_blocks_find_the_pairs_of_open_buckets(llm, rng):
    words = sentence(rng, 60).split()
    docs = llm.createDataFrame([(i, " ".join(edited(rng, words, 1 + i % 4))) for i in range(60)], "doc_id long, text string")
    sets = jaccard.set_table(docs)
    counted = sets.select(F.col("set_id").alias("node"), F.col("n_shingles").alias("n"), "cells")
    buckets = sets.select(F.lit(1).cast("long").alias("sig"), F.col("set_id").alias("node"), F.pmod("set_id", F.lit(5)).alias("c"))
    two = (counted.select(F.col("node").alias(x)) for x in ("a", "b"))
    label = {r.node: r.c for r in buckets.collect()}
    every = jaccard.possible(next(two).join(next(two), F.col("a") < F.col("b")), counted, 80).collect()
    want = {(r.a, r.b) for r in every if label[r.a] != label[r.b]}
    for block in (7, 512):
        assert {tuple(r) for r in jaccard.block_pairs(buckets, counted, 80, block).collect()} == want
    assert want
