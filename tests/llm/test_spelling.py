import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from obsflow.llm import spelling

from .conftest import ODD, SCHEMA

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, every=97, shortest=5, least=3, factor=2):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    out = {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = others[0] if others and words[others[0]] >= factor * n else None
        out[w] = [w, form, w, n, len(others), words[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def found(df, **options):
    return sorted(tuple(r) for r in spelling.variants(df, **options).select(*COLUMNS).collect())


def misspelled(rng, word, alphabet):
    i, c = rng.randrange(len(word)), rng.choice(alphabet)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def corpus(seed, alphabet="abcdeé", stems=25, rows=120):
    rng = random.Random(seed)
    stem = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(stems)]
    pool = stem * 6 + [misspelled(rng, w, alphabet) for w in stem for _ in range(4)] * 2
    return [(rng.choice([i, i, None]), " ".join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(pool, k=60))) for i in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(llm, seed):
    rows = corpus(seed)
    assert found(llm.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_other_parameters(llm):
    rows = corpus(3, alphabet="ab", stems=10, rows=40)
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(df, every=3, shortest=3, least=1, factor=1.5) == brute(rows, 3, 3, 1, 1.5)


def test_large_groups_are_dealt_again(llm):
    rng = random.Random(5)
    words = sorted({"prefix" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) + "suffix" for _ in range(300)})
    df = llm.createDataFrame([(w, 1) for w in words], "word string, n long")
    whole = spelling.members(df)
    dealt = spelling.refined(whole, cells=200)
    assert dealt.select("a", "b").distinct().count() > whole.select("a", "b").distinct().count()
    expected = sorted((a, b) for a in words for b in words if near(a, b))
    for rows in (whole, dealt):
        assert sorted((r["word"], r["near"]) for r in spelling.near_in_groups(rows).collect()) == expected


def test_scan_equals_brute_force():
    rng = random.Random(7)
    groups = [sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (rng.choice([t, t + 1]) for _ in range(40))}) for t in (0, 1, 2, 5, 9)]
    words = [w for g in groups for w in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    queries = [i for i, w in enumerate(words) if len(w) == (0, 1, 2, 5, 9)[group[i]]]  # the shorter words of each group
    codes = np.zeros((len(words), 12), np.uint32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = [ord(c) for c in w]
    left, right = spelling.within_one(codes, np.array(list(map(len, words))), group, np.array(queries))
    expected = [(i, j) for i in queries for j, b in enumerate(words) for a in [words[i]] if group[i] == group[j] and near(a, b)]
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == expected


def test_odd_rows(llm, odd, none, clashing):
    assert found(odd, least=1) == brute([r[:2] for r in ODD], least=1)
    assert found(clashing, least=1) == found(odd, least=1)
    assert found(none) == []


def test_long_runs(llm):
    rng = random.Random(9)
    long = "".join(rng.choice("xyzë") for _ in range(5000))
    rows = [(i, f"{long} {long[:70]} {misspelled(rng, long, 'xyz')} {long[:4000]}q{long[4000:]}") for i in range(3)] * 3
    df = llm.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert found(df) == brute(rows)


def test_ties_take_the_smaller_word(llm):
    rows = [(i, "words wordz wordz words worda worda " * 2 + "word woord") for i in range(3)]
    expected = brute(rows)
    assert found(llm.createDataFrame(rows, "doc_id long, text string")) == expected
    assert {r[0]: r[1] for r in expected}["woord"] is None
