import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from obsflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows, family=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, tie(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    if not family:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, n=60, shared=3, longest=11):
    """Conversations that share first turns, some of them copies, with ids of several families."""
    rng = random.Random(seed)
    base = [[(rng.choice(["user", "assistant"]), " ".join(rng.choices(["a", "bb", "c\n", "é"], k=rng.randint(0, 6)))) for _ in range(longest)] for _ in range(shared)]
    rows = []
    for _ in range(n):
        c, path = rng.randint(-30, 400), rng.choice(base)[: rng.randint(1, longest)]
        if rng.random() < 0.5:
            path = path[:-1] + [("user", f"own {rng.randint(0, 3)}")]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(path)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(llm, seed):
    rows = made(seed)
    assert found(prefix_trie.conversation_trie(llm.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rebuilt(rows))


def test_without_heads(llm):
    rows = made(4, longest=18)
    assert found(prefix_trie.trie(prefix_trie.ordered_turns(llm.createDataFrame(rows, SCHEMA)))) == brute(rebuilt(rows, family=False))


def test_a_conversation_longer_than_a_slice(llm):
    rng = random.Random(5)
    long = [(40, t, "user", f"turn {rng.randint(0, 9)}") for t in range(700)]
    rows = long + [(c, t, r, x) for c in (41, 42, 43, 44, 45, 60) for _, t, r, x in long[: 300 + c]] + made(6, n=20)
    df = llm.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.ordered_turns(df)
    largest = turns.groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest < 0.5 * len(rows)
    assert turns.where("conv_id = 40").select("_slice").distinct().count() > 1
    assert found(prefix_trie.conversation_trie(df)) == brute(rebuilt(rows))


def test_many_copies(llm):
    path = [("user", "one two"), ("assistant", "three"), ("user", "four five six"), ("assistant", ""), ("user", "seven")]
    rows = [(c, t, r, x) for c in range(0, 2000, 2) for t, (r, x) in enumerate(path)] + made(7, n=10)
    assert found(prefix_trie.conversation_trie(llm.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))


def test_odd_rows(llm):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "", "y"), (2, None, "user", None), (3, 5, None, ""),
        (None, 1, "user", "nobody"), (None, None, None, None), (20, 0, "user", "word " * 40_000), (21, 0, "user", "word " * 40_000), (21, 1, "a:", ":b"), (22, 1, "a", "::b"), (22, 0, "user", " \t\n"),
    ]
    df = llm.createDataFrame(rows, SCHEMA)
    expected = brute(rebuilt(rows))
    assert any(len(p) == 0 for p in rebuilt(rows).values())  # a rebuilt conversation without turns
    assert found(prefix_trie.conversation_trie(df)) == expected
    names = ["depth", "n_convs", "total", "block", "position", "head", "skip", "words", "digest", "i", "p1"]
    assert found(prefix_trie.conversation_trie(df.withColumns({n: F.lit("x") for n in names}))) == expected


def test_empty_table(llm):
    assert found(prefix_trie.conversation_trie(llm.createDataFrame([], SCHEMA))) == []
    assert found(prefix_trie.conversation_trie(llm.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []
