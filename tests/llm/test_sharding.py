import hashlib
import math
import zlib
from collections import Counter

from obsflow.llm import sharding

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def cost(key, shard, weight=1.0):
    u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


def test_equals_brute_force(odd):
    got = sharding.document_shards(odd).collect()
    assert sharding.document_shards(odd).columns == COLUMNS and len(got) == odd.count()
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        draws = [cost(key, s) for s in range(41)]
        assert r.shard == draws.index(min(draws[:40])) and r.grown_shard == draws.index(min(draws))
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sizes == want
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in Counter(r.shard for r in got).items() for i in range(n))


def test_growth_and_weights(llm):
    ids = llm.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(ids, [1.0, 2.0, 1.0, 0.0], [1.0]).collect()
    count = Counter(r.shard for r in rows)
    assert count[3] == 0 and abs(count[1] - 2000) < 150 and abs(count[0] - 1000) < 150
    assert all(r.grown_shard in (r.shard, 4) for r in rows) and abs(sum(r.grown_shard == 4 for r in rows) - 800) < 120


def test_slots_do_not_depend_on_slices(llm):
    placed = sharding.assign_shards(llm.range(1000).withColumnRenamed("id", "doc_id"), [1.0] * 3)
    for rows in (7, 100_000):
        got = sharding.number_slots(placed, 3, ["doc_id"], slice_rows=rows).collect()
        assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in Counter(r.shard for r in got).items() for i in range(n))


def test_empty_and_clashing(none, clashing):
    assert sharding.document_shards(none).count() == 0
    out = sharding.number_slots(sharding.assign_shards(clashing, [1.0] * 4, [1.0]), 4, ["doc_id"])
    assert out.columns.count("shard") == 1 and out.count() == clashing.count() and dict(out.dtypes)["shard"] == "int"
