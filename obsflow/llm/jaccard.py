"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its word shingles. Sets fall into bands of size; the larger set of a similar pair lies in
the band of the smaller one or the next. For each set the symmetric difference of a similar pair is at most ``k``. The hash domain is
cut into ``n1`` parts, each into ``n2`` cells, and of each part every subset of ``n2 - k2`` cells gives a signature: a hash of what the
set holds in these cells. At least ``t = n1 - k // (k2 + 1)`` parts differ in at most ``k2`` cells, so similar sets share so many signatures.
A subset without any element gives none; a set in which ``t`` parts have an empty subset is *thin* and repeats the enumeration
under another cut of the domain. Both sets of a pair lost to empty subsets are thin, so the pair meets in a later cut; the last cut keeps
empty subsets. Of the shared signatures one is enough, so every set leaves out its most frequent ones, one fewer than it must share with a
similar set: the rarest shared signature is left out by neither. Any order would do, as long as all sets have the same; frequencies come from a
sample, so passages in many documents seldom make buckets. No similar pair is lost.

Equal sets are one node. Sets that share a signature form a bucket. First every set is compared with the least set of each of its buckets.
Where what remains of a bucket lies in several components, all its pairs between components are held against the cell counts inside tasks, in
blocks of bounded size, and only those that may be similar come out. Buckets are never gathered, but this last step grows with the square of
a bucket whose sets share a rare signature and are not similar.
Signatures that are very frequent in the sample are salted in the first shuffle.

A pair is first held against the counts of its shingles in ``CELLS`` cells of the hash domain: their distance never exceeds the
symmetric difference, so a pair it rules out is not similar. The others are compared by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsflow.llm.components import connected
from obsflow.llm.text import STEP, WORD_PIECE_BYTES, combine, lists, mix, pieces, signed, with_end, word_hashes
from obsflow.session import checkpointed

WORDS, PERCENT = 5, 80
LEVELS = 6
HOT_SAMPLE, HOT_SHARE, SALTS = 20_000, 0.01, 64
FREQUENT, MOST_FREQUENT = 3, 200_000  # signatures found so often in the sample are left out first; at most so many are broadcast
WIDE = 4  # growth of the bands of large sets
BROADCAST_NODES = 500_000
CELLS, BLOCK = 256, 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text with fewer words has its whole sequence as one shingle."""
    hashes, _, first = word_hashes(data, offsets)
    grams = combine(hashes, width)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mix(combine(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of every set."""
    size = np.array([len(s) for s in sets], np.uint64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt * STEP & (1 << 64) - 1)), dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + size * np.uint64(STEP)))
    return out[0], out[1]


class Bands:
    """Size bands of a similarity in percent, grown on demand: largest size, ``k``, ``k2``, ``n2`` and ``n1`` of each.

    Bands of small sets span one similar pair. Those of large sets are ``WIDE``, so that few sets stand beside a band below.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, self.low, self.high = percent, [1], []

    def upto(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            high = self.low[-1] * 100 // self.percent
            self.high.append(high if self.apart(high) <= 12 else self.low[-1] * WIDE)
            high = self.high[-1]
            self.low.append(high + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.high), sizes)

    def apart(self, size):
        """The largest symmetric difference of a set and a similar one that is at most as large, or larger."""
        return (size + size * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def cut(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``k, k2, n2, n1``; few differences are enumerated as two of three cells, many as twice as many single cells."""
        k = self.apart(np.array(self.high, np.int64)[band])
        k2 = ((k > 0) & (k <= 12)).astype(np.int64)
        n2 = np.where(k2 == 1, 3, 1)
        spare = np.where(k == 0, 0, np.where(k2 == 1, 1 + k // 8, k))
        return k, k2, n2, k // (k2 + 1) + 1 + spare


def rarest(sig: np.ndarray, holder: np.ndarray, drop: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of the signatures without the ``drop`` most frequent of every holder; ``frequent`` are signatures in order and their counts."""
    known, counts = frequent
    times = np.zeros(len(sig), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
        times = np.where(known[at] == sig, np.minimum(counts[at], 255), 0).astype(np.uint64)
    order = np.argsort(times << np.uint64(56) | sig >> np.uint64(8), kind="stable")
    order = order[np.argsort(holder[order], kind="stable")]
    size = np.bincount(holder, minlength=len(drop))
    first = np.cumsum(size) - size
    mine = holder[order]
    return order[np.arange(len(order)) - first[mine] < (size - drop)[mine]]


NONE_FREQUENT = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def signatures(sets: list[np.ndarray], bands: Bands, levels: int = LEVELS, frequent: tuple[np.ndarray, np.ndarray] | None = NONE_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and the set each belongs to; with ``frequent`` None also those that are left out. An empty set has none."""
    size = np.array([len(s) for s in sets], np.int64)
    own = np.full(len(sets), -1)
    own[size > 0] = bands.of(size[size > 0])
    found, where = [], []
    for step in (0, 1):  # as a set of its own band, and as the larger set beside one of the band below
        todo = np.flatnonzero(own - step >= 0)
        if step:
            todo = todo[size[todo] <= np.array(bands.high, np.int64)[own[todo] - 1] * 100 // bands.percent]
        for level in range(levels):
            if not len(todo):
                break
            band = own[todo] - step
            k, k2, n2, n1 = bands.cut(band)
            share = n1 - np.minimum(k, bands.apart(size[todo])) // (k2 + 1)  # parts that a similar set shares
            flat = np.concatenate([sets[i] for i in todo])
            owner = np.repeat(np.arange(len(todo)), size[todo])
            salt = mix((np.uint64(1000 * level + 1) + band.astype(np.uint64)) * np.uint64(STEP))
            cells = n1 * n2
            base = np.cumsum(cells) - cells
            total = int(cells.sum())
            cell = base[owner] + (mix(flat ^ salt[owner]) % cells.astype(np.uint64)[owner]).astype(np.int64)
            content = np.zeros(total, np.uint64)
            np.add.at(content, cell, mix(flat + np.uint64(STEP)))
            count = np.bincount(cell, minlength=total)
            holder = np.repeat(np.arange(len(todo)), cells)
            inside = np.arange(total) - base[holder]
            last = level == levels - 1
            poor = np.zeros(len(todo), np.int64)
            single = n2[holder] == 1
            name = mix(content + salt[holder] + inside.astype(np.uint64) * np.uint64(STEP))
            keep = single & ((count > 0) | last)
            names, holders = [name[keep]], [holder[keep]]
            poor += np.bincount(holder[single & (count == 0)], minlength=len(todo))
            three = np.flatnonzero(~single).reshape(-1, 3)
            if len(three):
                all_content = (content[three] * np.array([3, 5, 7], np.uint64)).sum(axis=1, dtype=np.uint64)
                full = count[three].sum(axis=1)
                empty = np.zeros(len(three), bool)
                for j in range(3):  # the subset without cell j
                    rest = full - count[three[:, j]]
                    value = mix(all_content - content[three[:, j]] * np.uint64((3, 5, 7)[j]) + salt[holder[three[:, j]]] + (inside[three[:, j]] + 1).astype(np.uint64) * np.uint64(STEP))
                    keep = (rest > 0) | last
                    names.append(value[keep])
                    holders.append(holder[three[keep, j]])
                    empty |= rest == 0
                poor += np.bincount(holder[three[empty, 0]], minlength=len(todo))
            names, holders = np.concatenate(names), np.concatenate(holders)
            if frequent is not None:
                left = rarest(names, holders, np.maximum(share - 1 - (0 if last else poor), 0), frequent)
                names, holders = names[left], holders[left]
            found.append(names)
            where.append(todo[holders])
            todo = todo[poor >= share]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


def set_table(docs: DataFrame, width: int = WORDS, seed: int = 0) -> DataFrame:
    """``doc_id, n_shingles, set_id, check, cells`` of every row: digests of the set, and its shingles counted by cells of the hash domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1), WORD_PIECE_BYTES):
                sets = shingle_sets(data, offsets, width)
                a, b = digests(sets, seed)
                size = np.array([len(s) for s in sets], np.int64)
                cell = (np.concatenate(sets) >> np.uint64(56)).astype(np.int64) + CELLS * np.repeat(np.arange(len(sets)), size)
                cells = np.minimum(np.bincount(cell, minlength=CELLS * len(sets)), 127).astype(np.int8)
                counted = lists(cells, np.arange(len(sets) + 1) * CELLS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(signed(a)), pa.array(signed(b)), counted],
                    names=["doc_id", "n_shingles", "set_id", "check", "cells"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id bigint, check bigint, cells array<tinyint>")


def signature_rows(docs: DataFrame, width: int, percent: int, seed: int, hot: DataFrame | None) -> DataFrame:
    """``sig, salt, node`` of every row, of equal sets in one piece of a batch only the first.

    ``hot`` is the table of :func:`hot_signatures`: what is in it is left out first, and what is salted there gets a salt above 0. Without it all
    signatures are given.
    """
    frequent = None
    if hot is not None:
        rows = hot.orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).toArrow().combine_chunks()
        sig, n, salted = (rows[c].to_numpy() for c in ("sig", "n", "salted"))
        order = np.argsort(sig.view(np.uint64))
        frequent = sig.view(np.uint64)[order], n[order], salted[order]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, often = Bands(percent), shared.value
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0), WORD_PIECE_BYTES):
                sets = shingle_sets(data, offsets, width)
                node = signed(digests(sets, seed)[0])
                first = np.sort(np.unique(node, return_index=True)[1])
                sig, where = signatures([sets[i] for i in first], bands, frequent=often and often[:2])
                owner = node[first[where]]
                salt = np.zeros(len(sig), np.int32)
                if often and len(often[0]):
                    at = np.minimum(np.searchsorted(often[0], sig), len(often[0]) - 1)
                    very = (often[0][at] == sig) & often[2][at]
                    salt = np.where(very, 1 + (owner.view(np.uint64) % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(salt), pa.array(owner)], names=["sig", "salt", "node"])

    return docs.select("text").mapInArrow(run, "sig bigint, salt int, node bigint")


def hot_signatures(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """``sig, n, salted``: signatures that ``FREQUENT`` or more of a sample of about ``HOT_SAMPLE`` rows have, salted from ``HOT_SHARE`` of it on.

    They only decide what is left out and salted.
    """
    total = docs.select(F.count(F.lit(1))).first()[0]
    share = min(1.0, HOT_SAMPLE / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot signatures")), F.lit(1 << 30)) < int(share * (1 << 30)))
    least = max(20, int(HOT_SHARE * share * total))
    rows = signature_rows(sample, width, percent, seed, None)
    return rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).withColumn("salted", F.col("n") >= least)


def set_contents(docs: DataFrame, sets: DataFrame, width: int, seed: int, wanted: DataFrame) -> DataFrame:
    """``node, n, shingles`` of the sets in ``wanted``, once each.

    Few sets are looked up by one document of each, so that the other documents are not cut into shingles again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0), WORD_PIECE_BYTES):
                contents = shingle_sets(data, offsets, width)
                node, _ = digests(contents, seed)
                first = np.sort(np.unique(node, return_index=True)[1])
                flat = [contents[i] for i in first]
                size = np.array([len(s) for s in flat], np.int64)
                values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
                shingles = lists(signed(values), np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(node[first])), pa.array(size), shingles], names=["node", "n", "shingles"])

    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    if few:
        held = sets.join(F.broadcast(wanted.withColumnRenamed("node", "set_id")), "set_id", "left_semi")
        ids = checkpointed(held.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
        docs = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    rows = docs.select("text").mapInArrow(run, "node bigint, n bigint, shingles array<bigint>")
    mine = rows.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    return mine.groupBy("node").agg(F.first(F.struct("n", "shingles")).alias("c")).select("node", "c.n", "c.shingles")


def possible(pairs: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """The pairs whose cell counts don't rule them out; ``counted`` has ``node, n, cells``."""
    left, right = (counted.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, counted: DataFrame, width: int, seed: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar; with ``counted`` None all of them are compared."""
    pairs = checkpointed(pairs if counted is None else possible(pairs, counted, percent))
    if pairs.isEmpty():
        return pairs
    wanted = checkpointed(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    contents = checkpointed(set_contents(docs, sets, width, seed, wanted))
    left = contents.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = contents.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return checkpointed(both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"))


def bucket_table(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """``sig, node`` of all buckets with several different sets."""
    hot = checkpointed(hot_signatures(docs, width, percent, seed))
    rows = signature_rows(docs, width, percent, seed, hot).repartition("sig", "salt")
    group = Window.partitionBy("sig", "salt")
    several = rows.withColumns({"_lo": F.min("node").over(group), "_hi": F.max("node").over(group)}).where("salt > 0 or _lo != _hi")
    met = checkpointed(several.groupBy("sig", "salt", "node").agg(F.count(F.lit(1)).alias("_n")).select("sig", "salt", "node"))
    true = met.where("salt > 0").groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("sig")
    return met.where("salt = 0").select("sig", "node").union(met.where("salt > 0").join(true, "sig", "left_semi").select("sig", "node"))


def open_buckets(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """``sig, node, c``: the buckets that hold several components."""
    labelled = checkpointed(buckets.join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c")))
    mixed = labelled.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("sig")
    return checkpointed(labelled.join(mixed, "sig", "left_semi"))


def block_pairs(buckets: DataFrame, counted: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``a, b`` of one bucket and different components whose cell counts don't rule them out.

    The sets of a bucket are cut into blocks, and every two blocks meet in a group of bounded size.
    """
    sizes = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("_m")).withColumn("blocks", F.ceil(F.col("_m") / block))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = buckets.join(sizes, "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = placed.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "c")
    keys = ["sig", "lo", "hi"]
    rows = met.join(counted, "node").select(*keys, "own", "node", "c", "n", "cells").repartition(*keys).sortWithinPartitions(*keys)

    def pairs(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, own, node, part, n = (group.column(i).to_numpy() for i in range(1, 7))
        cells = group.column(7).flatten().to_numpy().reshape(len(node), CELLS).astype(np.int16)
        _, which, times = np.unique(part, return_inverse=True, return_counts=True)
        order = np.lexsort((which, times[which]))  # the largest component last: its members are not compared with each other
        own, node, part, n, cells = (x[order] for x in (own, node, part, n, cells))
        left, right = [node[:0]], [node[:0]]
        for i in range(len(node) - int(times.max())):
            some = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & ((lo[0] == hi[0]) | (own[i + 1 :] != own[i])))
            some = some[(100 + percent) * np.abs(n[some] - n[i]) <= (100 - percent) * (n[some] + n[i])]
            apart = np.abs(cells[some] - cells[i]).sum(axis=1, dtype=np.int64)
            some = some[(100 + percent) * apart <= (100 - percent) * (n[some] + n[i])]
            left.append(np.minimum(node[some], node[i]))
            right.append(np.maximum(node[some], node[i]))
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in with_end(batches):
            held = [b for b in (rest, batch) if b is not None and b.num_rows]
            if not held:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = [rows.column(i).to_numpy() for i in range(3)]
            start = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            end = np.append(start[1:], len(rows))
            whole = len(start) if batch is None else len(start) - 1
            found = [pairs(rows.slice(a, b - a)) for a, b in zip(start[:whole].tolist(), end[:whole].tolist(), strict=True) if b - a > 1]
            if found:
                both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            rest = rows.slice(start[whole]) if whole < len(start) else None

    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_links(docs: DataFrame, sets: DataFrame, width: int = WORDS, percent: int = PERCENT, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``links`` (a, b) between the ids of similar different sets, enough to connect all that are similar, and ``node, component``.

    ``sets`` is the :func:`set_table` of ``docs``. A set that no other is similar to has no component row.
    """
    buckets = bucket_table(docs, width, percent, seed)
    used = sets.join(buckets.select(F.col("node").alias("set_id")).distinct(), "set_id", "left_semi")
    first = used.groupBy("set_id").agg(F.first(F.struct("n_shingles", "cells")).alias("c"))
    counted = checkpointed(first.select(F.col("set_id").alias("node"), F.col("c.n_shingles").alias("n"), "c.cells"))
    least = buckets.groupBy("sig").agg(F.min("node").alias("a"))
    pairs = buckets.join(least, "sig").where("a != node").select("a", F.col("node").alias("b")).distinct()
    links = verified(docs, sets, pairs, counted, width, seed, percent)
    parts = checkpointed(connected(links))
    rest = buckets.join(least.withColumnRenamed("a", "node"), ["sig", "node"], "left_anti")
    new = verified(docs, sets, block_pairs(open_buckets(rest, parts), counted, percent).distinct(), None, width, seed, percent)
    if new.isEmpty():
        return links, parts
    links = checkpointed(links.union(new))
    return links, checkpointed(connected(links))


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: the smallest id that links of similar sets reach.

    Words are case-folded (A-Z) runs of non-space characters. A document without words has an empty set and links with nothing, as does
    one with a null text; its component is its own id. Equal sets link. Rows with a null id count for links but give no id.
    """
    seed = 0
    while True:
        sets = checkpointed(set_table(docs, width, seed))
        clash = sets.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi")
        if clash.isEmpty():
            break
        seed += 1
    _, parts = similar_links(docs, sets, width, percent, seed)
    nodes = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    in_part = nodes.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = in_part.select("set_id", F.coalesce("component", "set_id").alias("c"), "least")
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "c").select("set_id", "component_id")
    linked = sets.where("n_shingles > 0").join(labels, "set_id").select("doc_id", "n_shingles", "component_id")
    return linked.union(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of every component only the smallest id does.

    Documents without words stay. Of rows with one id and text one stays; rows with one id and different texts stay or go together. Rows
    without an id can't be named and stay.
    """
    parts = checkpointed(jaccard_components(docs, width, percent))
    losers = parts.where("doc_id != component_id").select("doc_id").distinct()
    again = parts.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    small = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else ids
    kept = docs.join(small(losers), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    twice = kept.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(again), "doc_id", "left_anti").select(docs.columns).union(twice.select(docs.columns))
