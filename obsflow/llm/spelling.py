"""Words of a corpus that differ from each other by one inserted, deleted or replaced code point, and the more frequent form of each.

Two words within one edit share the first or the second half of the shorter one, so every word is dealt to the groups of its halves
(:func:`members`). A group that is too large is dealt again by the halves of the part not yet shared (:func:`refined`), until that part is
one code point and the alphabet bounds the group. Inside a group the unshared parts are a sorted list, scanned by dynamic programming
(:func:`near_in_groups`): a row of the edit matrix, banded to three cells, belongs to a range of the list with a common prefix, is reused by all words
of the range, and the range is skipped once every cell is above one.

A null text has no words, a null id counts as an empty one, repeated rows count again, and an empty table gives an empty one. Runs of letters of any length are
words. Extra columns are ignored. The more frequent word wins, then the smaller in code-point order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.text import LOWER, distinct_segments, pieces, word_spans
from obsflow.session import checkpointed

SLIP_EVERY = 97
MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2

#: A group with more unshared code points than this is dealt again.
GROUP_CELLS = 1 << 17
#: A task looks for the neighbours of so many words at a time.
QUERIES_AT_ONCE = 8192
PIECE = 4 << 20
FAR = np.int8(9)

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, continued from ``seed``: one byte of all short ranges at a time."""
    out = seed.astype(np.uint32)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]], int(seed[i]))
    order = np.flatnonzero(size <= 64)
    order = order[np.argsort(-size[order], kind="stable")]
    at, left, state = start[order], size[order], ~out[order]
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k, side="left"))  # ranges with more than k bytes
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def runs(data: np.ndarray, offsets: np.ndarray, ids: list[str], every: int, shortest: int) -> tuple[list[str], np.ndarray]:
    """Distinct words of a piece of texts and how often each occurs; one run in ``every`` has lost a code point."""
    wide = data == 0xC3  # first byte of U+00C0 to U+00FF
    word = _letter[data] | wide
    word[1:] |= wide[:-1]
    start, end, text = word_spans(word, offsets)
    length = (end - start) - np.diff(np.concatenate([[0], np.cumsum(wide)])[np.stack([start, end])], axis=0)[0]
    keep = length >= shortest
    start, end, text, length = start[keep], end[keep], text[keep], length[keep]
    if not len(start):
        return [], np.zeros(0, np.int64)
    size, body = end - start, LOWER[data]
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    found = checksums(body, start, size, seeds[text])
    slip = found % np.uint32(every) == 0
    counts: dict[str, int] = {}
    for a, b, h, n in zip(start[slip].tolist(), end[slip].tolist(), found[slip].tolist(), length[slip].tolist(), strict=True):
        if n > shortest:
            run, cut = body[a:b].tobytes().decode(), h % n
            slipped = run[:cut] + run[cut + 1 :]
            counts[slipped] = counts.get(slipped, 0) + 1
    start, size = start[~slip], size[~slip]
    before = np.cumsum(size) - size
    words, which = distinct_segments(body[np.repeat(start - before, size) + np.arange(int(size.sum()))], before)
    times = np.bincount(which, minlength=len(words))
    return [w.decode() for w in words] + list(counts), np.concatenate([times, np.fromiter(counts.values(), np.int64, len(counts))])


def vocabulary(docs: DataFrame, *, every: int = SLIP_EVERY, shortest: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words with at least ``shortest`` code points and ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            for lo, hi, data, offsets in pieces(batch.column(1), PIECE):
                words, times = runs(data, offsets, ids[lo:hi], every, shortest)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _with_shared(rows: DataFrame) -> DataFrame:
    """``shared``: the first ``a`` and the last ``b`` code points, which all words of a group have."""
    return rows.withColumn("shared", F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"), F.right("word", F.col("b"))))


def members(words: DataFrame, shortest: int = MIN_LENGTH) -> DataFrame:
    """``word, n, length, a, b, below, shared``: every word in its groups.

    A group is for pairs whose shorter word has ``length`` code points, and holds words of that length and one more. A pair that already shares the first half is not
    looked for in the group of the second half: ``below`` bounds its common prefix there.
    """
    shorter = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")
    half = F.floor(F.col("length") / 2).cast("int")
    zero, none = F.lit(0), F.lit(2**31 - 1)
    front = F.struct(half.alias("a"), zero.alias("b"), none.alias("below"))
    back = F.struct(zero.alias("a"), (F.col("length") - half).alias("b"), half.alias("below"))
    dealt = words.select("word", "n", shorter).where(F.col("length") >= shortest)
    return _with_shared(dealt.select("word", "n", "length", F.inline(F.array(front, back))))


GROUP = ["length", "a", "b", "below", "shared"]


def refined(rows: DataFrame, cells: int = GROUP_CELLS) -> DataFrame:
    """The same rows, large groups dealt again by the halves of their unshared part. Every round halves that part."""
    left = F.col("length") - F.col("a") - F.col("b")
    kept: list[DataFrame] = []
    while True:
        large = checkpointed(rows.groupBy(*GROUP).agg(F.count("*").alias("_size")).where((F.col("_size") * left > cells) & (left > 1)).drop("_size"))
        if large.isEmpty():
            kept.append(rows)
            break
        kept.append(rows.join(large, GROUP, "left_anti"))
        half = F.floor(left / 2).cast("int")
        front = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("below").alias("below"))
        back = F.struct(F.col("a").alias("a"), (F.col("b") + left - half).alias("b"), F.least("below", F.col("a") + half).alias("below"))
        again = rows.join(large, GROUP, "left_semi").select("word", "n", "length", F.inline(F.array(front, back)))
        rows = checkpointed(_with_shared(again).select(rows.columns))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def within_one(codes: np.ndarray, length: np.ndarray, group: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) of rows of one group with exactly one edit between them.

    A query is no longer than the other rows of its group. ``codes`` has the code points of a row, padded with zeros; rows are sorted by group and codes, and differ inside a group. A state is a query, a range
    of rows that share their first ``d`` code points, and the cells d-1, d, d+1 of the edit row of that prefix.
    """
    n, width = codes.shape
    same = np.concatenate([[False], group[1:] == group[:-1]])
    differs = np.ones((n, width + 1), bool)
    differs[1:, :width] = codes[1:] != codes[:-1]
    shared = np.where(same, differs.argmax(1), -1)  # with the row before
    first = np.searchsorted(group, group[query], side="left")
    last = np.searchsorted(group, group[query], side="right")
    q, lo, hi = query, first, last
    cells = np.tile(np.array([[FAR], [0], [1]], np.int8), (1, len(query)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    padded = np.concatenate([np.zeros((n, 1), codes.dtype), codes, np.zeros((n, 2), codes.dtype)], axis=1)  # column j + 1 has code point j
    for d in range(width):
        if not len(q):
            break
        begins = np.append(np.flatnonzero(shared <= d), n)  # where ranges with one more code point in common begin
        count = np.concatenate([[0], np.cumsum(shared <= d)])
        number = count[hi] - count[lo]
        state = np.repeat(np.arange(len(q)), number)
        which = np.arange(int(number.sum())) + np.repeat(count[lo] - np.cumsum(number) + number, number)
        child, end = begins[which], begins[which + 1]
        here = codes[child, d]
        alive = here != 0
        state, child, end, here = state[alive], child[alive], end[alive], here[alive]
        own, old = q[state], cells[:, state]
        near = padded[own[:, None], np.arange(d, d + 3)] != here[:, None]  # code points d-1, d, d+1 of the query
        c0 = np.minimum(old[0] + near[:, 0], old[1] + 1)
        c1 = np.minimum(np.minimum(old[1] + near[:, 1], old[2] + 1), c0 + 1)
        c2 = np.minimum(old[2] + near[:, 2], c1 + 1)
        row = np.stack([c0, c1, c2]).astype(np.int8)
        column = length[own] - d  # the cell of the whole query
        whole = (length[child] == d + 1) & (column >= 0) & (column <= 2) & (child != own)
        hit = np.flatnonzero(whole)
        hit = hit[row[column[hit], hit] == 1]
        found.append((own[hit], child[hit]))
        going = np.flatnonzero(row.min(0) <= 1)
        q, lo, hi, cells = own[going], child[going], end[going], np.minimum(row[:, going], FAR)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _common(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    differs = np.ones((len(left), codes.shape[1] + 1), bool)
    differs[:, :-1] = codes[left] != codes[right]
    return differs.argmax(1)


def near_in_groups(rows: DataFrame) -> DataFrame:
    """``word, near, near_n`` of all near pairs, in both directions, each once."""
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "word")

    def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
        word = part["word"].combine_chunks().cast(pa.large_string())
        a, b, short, below = (part[c].to_numpy().astype(np.int64) for c in ("a", "b", "length", "below"))
        sizes = np.array([len(w) for w in word.to_pylist()], np.int64)
        flat = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), np.uint32)
        begin, length = np.cumsum(sizes) - sizes + a, sizes - a - b
        width = int(length.max(initial=0))
        if not width:
            return
        codes = np.zeros((len(sizes), width), np.uint32)
        inside = np.arange(width) < length[:, None]
        codes[inside] = flat[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        group = part["_group"].to_numpy()
        order = np.lexsort([*codes.T[::-1], group])  # the shared ends don't count
        codes, length, group, n = codes[order], length[order], group[order], part["n"].to_numpy()[order]
        a, short, below, sizes = a[order], short[order], below[order], sizes[order]
        word = word.take(pa.array(order))
        queries = np.flatnonzero(sizes == short)
        for k in range(0, len(queries), QUERIES_AT_ONCE):
            left, right = within_one(codes, length, group, queries[k : k + QUERIES_AT_ONCE])
            fresh = a[left] + _common(codes, left, right) < below[left]
            left, right = left[fresh], right[fresh]
            longer = sizes[right] > sizes[left]  # pairs of one length are found from both sides
            source, other = np.concatenate([left, right[longer]]), np.concatenate([right, left[longer]])
            names = word.take(pa.array(source)).cast(pa.string()), word.take(pa.array(other)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*names, pa.array(n[other])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, several at a time."""
        last, number, cells = None, -1, 0
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in GROUP]
            numeric, text = np.stack([k.to_numpy() for k in keys[:4]]), keys[4].dictionary_encode().indices.to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = (numeric[:, 1:] != numeric[:, :-1]).any(0) | (text[1:] != text[:-1])
            new[0] = tuple(k[0].as_py() for k in keys) != last
            last = tuple(k[batch.num_rows - 1].as_py() for k in keys)
            ids = number + np.cumsum(new)
            number = int(ids[-1])
            table = pa.Table.from_batches([batch]).append_column("_group", pa.array(ids))
            weight = numeric[0] + 1 - numeric[1] - numeric[2]
            edge = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if edge and cells + int(weight[:edge].sum()) > GROUP_CELLS:
                yield from solve(pa.concat_tables([*held, table.slice(0, edge)]))
                held, cells, table, weight = [], 0, table.slice(edge), weight[edge:]
            held.append(table)
            cells += int(weight.sum())
        if held:
            yield from solve(pa.concat_tables(held))

    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: forms are followed to the last, in steps that double."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = checkpointed(now.join(onward, "root", "left"))
        if joined.where(F.col("_next").isNotNull()).isEmpty():
            return now
        now = joined.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, *, every: int = SLIP_EVERY, shortest: int = MIN_LENGTH, least: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words.

    ``form`` is the near word of largest ``n``, if that is at least ``factor`` times the word's own; ``root`` is the last of the forms' forms, or the word itself.
    """
    words = checkpointed(vocabulary(docs, every=every, shortest=shortest, least=least))
    pairs = near_in_groups(refined(members(words, shortest)))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("_best"))
    strong = -F.col("_best.less") >= factor * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.less")).alias("form_n")
    )
    found = checkpointed(found)
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
