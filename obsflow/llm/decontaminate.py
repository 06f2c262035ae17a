"""Benchmark decontamination by latent semantic retrieval.

Words are case-folded runs of letters and digits. Benchmark items, cut into units of at most ``UNIT`` words, are rows of a TF-IDF matrix;
document frequencies count 64-word passages of all documents. A randomised SVD (Halko, Martinsson and Tropp) finds its leading right singular
vectors: every product with the matrix or its transpose is a Spark pass over the units, only matrices of vocabulary x rank come back. Every
window of a document, at three widths that fit the units' lengths, is folded into the latent space by adding the latent vectors of its words, and
compared by cosine with the units of its width. Candidates are checked on the words themselves: the longest common subsequence of unit
and window surroundings, and that of the answer, the last sentence of the item. Items are worked off in blocks of bounded size, so what is sent to
the tasks never grows with the benchmark or the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.text import LETTERS, pieces, range_hashes, word_spans

BLOCK_ITEMS, BLOCK_BYTES = 2000, 1 << 20
MIN_WORDS, UNIT, PASSAGE, STRIDE = 8, 64, 64, 8  # a unit's words fit the bits of one integer
WIDTHS = (16, 32, 64)  # for units of fewer than 24, fewer than 48, and more words
RANK, OVERSAMPLE, POWERS = 128, 16, 2
COSINE, SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.5, 0.8, 0.6, 0.8
PIECE = 1 << 18
CELLS = 1 << 20  # products of windows and units held at once

FOLD = LETTERS.copy()
FOLD[48:58] = np.arange(48, 58)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's words begin."""
    folded = FOLD[data]
    start, end, text = word_spans(folded != 32, offsets)
    return range_hashes(folded, start, end), np.searchsorted(text, np.arange(len(offsets)))


def words_of_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def answer_words(text: str) -> int:
    """Number of words in the last sentence of a text that has several, else 0."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if len(words_of_text(s))]
    return len(words_of_text(sentences[-1])) if len(sentences) > 1 else 0


@dataclass
class Unit:
    item: int
    words: np.ndarray  # places in the vocabulary
    answer: int  # so many last words are the answer


class Vocabulary:
    """Sorted word hashes of a block, with a coarse filter in front of the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known words and their places."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        right = self.hashes[place] == hashes[some]
        return some[right], place[right]


def cut_units(items: list[tuple[int, str]]) -> tuple[Vocabulary, list[Unit]]:
    """Vocabulary and units of a block; items with fewer than ``MIN_WORDS`` words have none, longer ones are cut evenly."""
    found = [(key, words_of_text(text), answer_words(text)) for key, text in items]
    found = [x for x in found if len(x[1]) >= MIN_WORDS]
    vocabulary = Vocabulary(np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.uint64))
    units = []
    for key, hashes, answer in found:
        places = np.searchsorted(vocabulary.hashes, hashes)
        parts = np.array_split(places, -(-len(places) // UNIT))
        for i, part in enumerate(parts):
            units.append(Unit(key, part, min(answer, len(part)) if i == len(parts) - 1 else 0))
    return vocabulary, units


def passage_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each word stands, and the number of passages."""
    size = len(vocabulary.hashes)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, count, passages = shared.value, np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0), PIECE):
                hashes, first = words_of(data, offsets)
                length = np.diff(first)
                cut = -(-length // PASSAGE)
                base = np.cumsum(cut) - cut
                passages += int(cut.sum())
                at, place = v.find(hashes)
                text = np.searchsorted(first, at, side="right") - 1
                passage = base[text] + (at - first[text]) // PASSAGE
                count += np.bincount(np.unique(passage * size + place) % size, minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], passages))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(size + 1, np.int64)
    for r in rows:
        count[r["word"]] = r["n"]
    return count[:-1], int(count[-1])


def tfidf_rows(units: list[Unit], idf: np.ndarray) -> list[tuple[list[int], list[float]]]:
    """Sparse rows of length one."""
    rows = []
    for u in units:
        place, times = np.unique(u.words, return_counts=True)
        value = times * idf[place]
        rows.append((place.tolist(), (value / max(np.linalg.norm(value), 1e-12)).tolist()))
    return rows


def gram_product(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """``A' (A right)`` of the distributed sparse rows ``place, value``, added up by word."""
    shared = matrix.sparkSession.sparkContext.broadcast(right)
    width = right.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        out = np.zeros_like(x)
        for rows in batches:
            for place, value in zip(rows["place"], rows["value"], strict=True):
                out[place] += np.outer(value, value @ x[place])
        some = np.flatnonzero(out.any(axis=1))
        yield pd.DataFrame(out[some], columns=[f"c{j}" for j in range(width)]).assign(word=some)

    schema = ", ".join(f"c{j} double" for j in range(width)) + ", word bigint"
    parts = matrix.mapInPandas(run, schema).groupBy("word").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)])
    out = np.zeros_like(right)
    for batch in parts.select("word", *[f"c{j}" for j in range(width)]).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = np.stack([batch.column(j + 1).to_numpy() for j in range(width)], axis=1)
    return out


def leading_vectors(matrix: DataFrame, words: int, rows: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Orthonormal right singular vectors (words x rank) of the distributed matrix, by the randomised range finder with power steps."""
    rank = max(1, min(rank, rows, words))
    width = min(rank + OVERSAMPLE, words)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((words, width)))
    for _ in range(POWERS):
        q, _ = np.linalg.qr(gram_product(matrix, q))
    _, turn = np.linalg.eigh(q.T @ gram_product(matrix, q))
    return q @ turn[:, ::-1][:, :rank]


class Matcher:
    """Longest common subsequences of many word lists with units, all at once, one bit per word of a unit."""

    def __init__(self, lists: list[np.ndarray], words: int):
        self.words = max(words, 1)
        key = np.concatenate([np.full(len(x), i) * self.words + x for i, x in enumerate(lists)]).astype(np.int64)
        bit = np.concatenate([np.left_shift(np.uint64(1), np.arange(len(x), dtype=np.uint64)) for x in lists])
        self.keys, at = np.unique(key, return_inverse=True)
        self.masks = np.zeros(len(self.keys), np.uint64)
        np.bitwise_or.at(self.masks, at, bit)
        self.length = np.array([len(x) for x in lists])

    def __call__(self, which: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Length for each pair of list ``which`` and the words ``place[start:end]``."""
        state = np.full(len(which), np.iinfo(np.uint64).max)
        if len(self.keys):
            for step in range(int((end - start).max(initial=0))):
                some = np.flatnonzero(start + step < end)
                key = which[some] * self.words + place[start[some] + step]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                some, mask = some[hit], self.masks[at[hit]]
                now = state[some]
                u = now & mask
                state[some] = (now + u) | (now - u)
        below = np.where(self.length >= 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(self.length, 63).astype(np.uint64)) - np.uint64(1))
        return np.bitwise_count(~state & below[which]).astype(np.int64)


class Searcher:
    """Finds the units of a block in pieces of text."""

    def __init__(self, vocabulary: Vocabulary, units: list[Unit], latent: np.ndarray):
        self.vocabulary, self.latent = vocabulary, latent.astype(np.float32)
        self.items = np.array([u.item for u in units])
        self.length = np.array([len(u.words) for u in units])
        self.answer = np.array([u.answer for u in units])
        self.whole = Matcher([u.words for u in units], len(vocabulary.hashes))
        self.last = Matcher([u.words[len(u.words) - u.answer :] for u in units], len(vocabulary.hashes))
        self.bands = []
        for width, low, high in zip(WIDTHS, (0, 24, 48), (24, 48, 1 << 40), strict=True):
            members = np.flatnonzero((self.length >= low) & (self.length < high))
            if len(members):
                vectors = np.stack([self.latent[units[i].words].sum(axis=0) for i in members])
                self.bands.append((width, members, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Columns text, unit, cosine, share, answer share, first and end word of the windows that pass the checks."""
        hashes, first = words_of(data, offsets)
        at, place = self.vocabulary.find(hashes)
        if not len(at):
            return []
        length = np.diff(first)
        spare = WIDTHS[-1] // STRIDE - 1
        blocks = -(-length // STRIDE) + spare  # empty blocks behind every text keep windows inside it
        base = np.cumsum(blocks) - blocks
        text = np.searchsorted(first, at, side="right") - 1
        block = base[text] + (at - first[text]) // STRIDE
        sums = np.zeros((int(blocks.sum()), self.latent.shape[1]), np.float32)
        new = np.flatnonzero(np.diff(block, prepend=-1))
        turn = np.arange(len(block)) - np.repeat(new, np.diff(np.append(new, len(block))))
        for k in range(STRIDE):  # the k-th known word of every block
            some = turn == k
            sums[block[some]] += self.latent[place[some]]
        owner = np.repeat(np.arange(len(length)), blocks)
        inside = np.arange(len(owner)) - base[owner]
        real = inside < blocks[owner] - spare
        found, done = [], 1
        for width, members, vectors in self.bands:
            while done * STRIDE < width:  # windows of twice the width from two neighbours
                sums[: len(sums) - done] += sums[done:].copy()
                done *= 2
            start = np.flatnonzero(real & (inside % max(1, done // 2) == 0))
            window = sums[start]
            norm = np.linalg.norm(window, axis=1)
            least, height = np.where(norm > 0, COSINE * norm, np.inf)[:, None], max(1, CELLS // len(vectors))
            near = [np.nonzero(window[i : i + height] @ vectors.T >= least[i : i + height]) for i in range(0, len(window), height)]
            row = np.concatenate([np.zeros(0, np.int64), *(i * height + r for i, (r, _) in enumerate(near))])
            column = np.concatenate([np.zeros(0, np.int64), *(c for _, c in near)])
            if not len(row):
                continue
            s, unit = start[row], members[column]
            t, n = owner[s], self.length[unit]
            begin = first[t] + inside[s] * STRIDE
            lo, hi = np.maximum(begin - n // 2, first[t]), np.minimum(begin + width + n // 2, first[t + 1])
            a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
            keep = b - a >= PARAPHRASE_SHARE * n  # fewer known words can't hold the share
            row, column, unit, t, n, lo, hi, a, b = (x[keep] for x in (row, column, unit, t, n, lo, hi, a, b))
            share = self.whole(unit, place, a, b) / n
            answer = np.where(self.answer[unit] > 0, self.last(unit, place, a, b) / np.maximum(self.answer[unit], 1), 0.0)
            keep = (share >= SHARE) | (share >= PARAPHRASE_SHARE) & (answer >= ANSWER_SHARE)
            cosine = np.einsum("ij,ij->i", window[row[keep]], vectors[column[keep]]) / norm[row[keep]]
            found.append([t[keep], unit[keep], cosine, share[keep], answer[keep], (lo - first[t])[keep], (hi - first[t])[keep]])
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else []


SCHEMA = "item_id bigint, cosine double, share double, answer_share double, first_word bigint, end_word bigint"


def search_block(docs: DataFrame, searcher: Searcher) -> DataFrame:
    """One row per document and item found, with its best window."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(searcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for batch in batches:
            for lo, _, data, offsets in pieces(batch.column(1), PIECE):
                columns = find(data, offsets)
                if columns and len(columns[0]):
                    text, unit, cosine, share, answer, start, end = columns
                    item = find.items[unit]
                    order = np.lexsort((start, -cosine, -answer, -share, item, text))  # the best window of a pair first
                    text, item = text[order], item[order]
                    best = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=item[0] - 1) != 0))
                    rest = [x[order][best] for x in (cosine.astype(float), share, answer, start, end)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(lo + text[best])), *map(pa.array, (item[best], *rest))],
                        names=["doc_id", "item_id", "cosine", "share", "answer_share", "first_word", "end_word"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def searchers(docs: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[Searcher]:
    """One searcher for each block of items; frequencies cover all ``docs``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        vocabulary, units = cut_units([(r["item_id"], r["text"]) for r in mine])
        if not units:
            continue
        frequency, passages = passage_frequencies(docs, vocabulary)
        idf = np.log((1 + passages) / (1 + frequency)) + 1e-3
        rows = docs.sparkSession.createDataFrame(tfidf_rows(units, idf), "place array<int>, value array<double>")
        vectors = leading_vectors(rows.repartition(max(1, len(units) // 500)), len(idf), len(units), rank)
        yield Searcher(vocabulary, units, vectors * idf[:, None])


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id`` with cosine, shares and word span of every benchmark item found in a document.

    An item is found where at least ``SHARE`` of its words, or of one unit of a long item, stand in order near a candidate window, or
    ``PARAPHRASE_SHARE`` of them and ``ANSWER_SHARE`` of the answer. Null texts hold nothing; items with a null id or text or fewer than
    ``MIN_WORDS`` words are not searched. Rows with repeated ids are each searched. Without items or documents the result is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"doc_id {kind}, {SCHEMA}")
    for searcher in searchers(docs, benchmark, rank):
        found = found.unionByName(search_block(docs, searcher))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found. Every row is judged where it lies, so null or repeated ids don't matter."""
    left = docs
    for searcher in searchers(docs, benchmark, rank):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in pieces(batch.column("text"), PIECE):
                    if columns := find(data, offsets):
                        clean[lo + columns[0]] = False
                yield batch.filter(pa.array(clean))

        left = left.mapInArrow(run, docs.schema)
    return left
