"""Token ids of documents in Parquet files that can be read by column, row group and page.

Texts are dealt by ranges of ``doc_id`` (ties by the text's hash) and sorted, so the files hold ids in ascending order. A task encodes
its slice and notes how many ids came before each document in it. ``tokens`` is a list column whose pages are dictionary encoded (ids are
few), sorted numbers fall back to delta encoding (writer version 2). Row groups and pages are bounded by parameters, and Parquet's
column and page indexes let a reader skip to single documents or read the counts without the ids. Starts follow from the counts
of the slices, one number per slice.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsflow.llm.text import IS_SPACE, distinct_segments, lists, pieces

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000
SCHEMA = "doc_id bigint, part int, before bigint, n_tokens bigint, tokens array<int>"

#: A worker forgets the segments it knows when they and their ids have so many bytes.
KNOWN_BYTES = 96 << 20
#: So many segments, and single texts among them, go through the tokenizer at a time.
NEW_SEGMENTS, ROWS = 20_000, 256
NEWLINE = 10

_plain = np.zeros(256, bool)  # ASCII characters that are seen and no white space to any tokenizer
_plain[0x21:0x7F] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_stop = np.zeros(256, bool)
_stop[[ord(c) for c in ".,;:!?"]] = True


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at texts, and at some of the places between which the pre-tokenizer never joins bytes.

    These are white space after a visible character, a stop after a letter, and a visible character after a single line feed. Characters
    outside ASCII count as letters only in the Latin-1 block; next to others no cut is made.
    """
    n = len(data)
    latin = np.zeros(n, bool)  # second byte of a Latin-1 letter
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    lead = np.zeros(n, bool)
    lead[:-1] = latin[1:]
    cut = np.zeros(n, bool)
    seen = _plain[data] | latin
    cut[1:] |= IS_SPACE[data[1:]] & seen[:-1]
    cut[1:] |= _stop[data[1:]] & (_letter[data[:-1]] | latin[:-1])
    cut[2:] |= seen[:-2] & (data[1:-1] == NEWLINE) & (_plain[data[2:]] | lead[2:])
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts by their segments; every distinct segment goes through the tokenizer once, until it is forgotten."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def tokenize(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments and the length of each. Segments without inner white space go in rows, cut at the line feeds between."""
        alone = [i for i, s in enumerate(segments) if len(s) > 200 or len(s[1:].split()) != 1 or s[1:].strip() != s[1:] or (s[0] != " " and s[0].isspace())]
        apart = set(alone)
        rest = [i for i in range(len(segments)) if i not in apart] if len(self.newline) == 1 else []
        if len(self.newline) != 1:
            alone = list(range(len(segments)))
        ids: list[list[int]] = [[]] * len(segments)
        for k in range(0, len(alone), ROWS):
            some = alone[k : k + ROWS]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([segments[i] for i in some], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        rows = [rest[k : k + 500] for k in range(0, len(rest), 500)]
        for k in range(0, len(rows), 8):
            texts = ["\n".join(segments[i] for i in row) for row in rows[k : k + 8]]
            for row, e in zip(rows[k : k + 8], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                found = e.ids
                at = [-1, *(j for j, x in enumerate(found) if x == self.newline[0]), len(found)]
                for i, lo, hi in zip(row, at[:-1], at[1:], strict=True):
                    ids[i] = found[lo + 1 : hi]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece in a row, and the number of each text's ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start = segment_starts(data, offsets)
        found, which = distinct_segments(data, start)
        if self.size > KNOWN_BYTES:
            self.forget()
        new = [s for s in found if s not in self.known]
        for k in range(0, len(new), NEW_SEGMENTS):
            some = new[k : k + NEW_SEGMENTS]
            ids, lengths = self.tokenize([s.decode() for s in some])
            body, at = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(lengths)])).tolist()
            for s, lo, hi in zip(some, at[:-1], at[1:], strict=True):
                self.known[s] = body[lo:hi]
                self.size += len(s) + hi - lo + 150
        parts = [self.known[s] for s in found]
        flat = np.frombuffer(b"".join(parts), np.int32)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        low, size = (np.cumsum(length) - length)[which], length[which]
        before = np.cumsum(size) - size
        ids = flat[np.repeat(low - before, size) + np.arange(int(size.sum()))]
        total = np.concatenate([before, [len(ids)]])
        return ids, np.diff(total[np.searchsorted(start, offsets)])


@lru_cache(1)
def shared_encoder(path: str) -> Encoder:
    """One encoder per worker process, so that a task knows the segments of the tasks before it."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` behind each."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], end_id, np.int32)
    keep = np.ones(bounds[-1], bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES,
                 page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``text`` of every document into Parquet files under ``folder``, in ascending ``doc_id`` (null first).

    A null text is empty; each document ends with ``end_id``. ``before`` counts the ids of the same slice (``part``) in front.
    """
    sliced = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = sliced.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = shared_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, text = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in pieces(text):
                ids, bounds = with_end(*encode(data, offsets), end_id)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), lists(ids, bounds)],
                    names=["doc_id", "part", "before", "n_tokens", "tokens"],
                )
                before += int(bounds[-1])

    (
        ordered.mapInArrow(run, SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(folder)
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, part, start, n_tokens`` of every document, without reading ids."""
    return started(spark.read.schema(SCHEMA).parquet(folder).drop("tokens"))


def started(rows: DataFrame) -> DataFrame:
    """``start``, the ids of all documents before, instead of ``before``. The totals are one row per slice, and so broadcast."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("part", F.coalesce(F.sum("_sum").over(behind), F.lit(0)).alias("_shift"))
    return rows.join(F.broadcast(shift), "part").withColumn("start", F.col("before") + F.col("_shift")).drop("before", "_shift")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, part, start, n_tokens, tokens`` of every document."""
    return started(spark.read.schema(SCHEMA).parquet(folder))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from what was read back; ids count as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            bounds = column.offsets.to_numpy()
            ids = column.values.to_numpy().astype("<u4", copy=False)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = tokens.select("doc_id", "start", "n_tokens", "tokens")
    return columns.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
