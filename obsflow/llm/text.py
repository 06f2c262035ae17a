"""Vectorised reading of whole texts inside Arrow tasks.

Texts are handled as UTF-8 bytes. White space (``\\x20 \\x09-\\x0D``) is ASCII, so splitting bytes at it gives the same words as
splitting code points. A task works through its batch in pieces of bounded bytes; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
#: Pieces whose words are hashed one by one.
WORD_PIECE_BYTES = 1 << 19
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2**64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters only: ASCII letters lower-cased, bytes of other scripts kept, everything else a space.
LETTERS = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """``STEP**i`` or its inverse, modulo 2**64, for i below n."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        factors = np.full(size, STEP if kind == "up" else pow(STEP, -1, 1 << 64), np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if size <= 8 * PIECE_BYTES:
            _powers[kind] = have
    return have[:n]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows with about ``limit`` bytes; a null text is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        texts = chunk.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            hi = min(hi, len(texts))
            yield row + lo, row + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
        row += len(texts)


def distinct_segments(data: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among segments that tile ``data``, and which of them each segment is. Bytes are compared, not hashes."""
    offsets = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def word_spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of True in ``word``; runs end with their text."""
    n = len(word)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    edge = offsets[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, text


#: Hash values of a byte at each of the first positions of a word.
_AT = 64
_placed: list[np.ndarray] = []


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not overlap and are not empty, to tell them apart.

    A hash is the sum of a value of its own for every position and byte, so no structure of a text makes two of them meet.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if not _placed:
        _placed.append(mix(np.arange(1, 256 * _AT + 1, dtype=np.uint64) * np.uint64(STEP)))
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    cell = place * 256 + data[np.repeat(start, size) + place]
    far = np.flatnonzero(place >= _AT)
    values = _placed[0][cell if not len(far) else np.minimum(cell, 256 * _AT - 1)]
    values[far] = mix((cell[far] + 1).astype(np.uint64) * np.uint64(STEP))
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64))


class Hasher:
    """64-bit hashes of byte ranges of one piece, for features; ranges may overlap. Equal byte strings have equal hashes, but texts can be made
    whose different strings have one, so it is not for telling strings apart.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values()[data] * _power("up", n), out=self.sums[1:])
        self.inverse = _power("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its text, and where each text's words begin (one more entry than texts)."""
    start, end, text = word_spans(~IS_SPACE[data], offsets)
    hashes = range_hashes(LOWER[data] if lower else data, start, end)
    return hashes, text, np.searchsorted(text, np.arange(len(offsets)))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(STEP) + hashes[i : i + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column from flat values and the bounds of each list."""
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values)).cast(pa.list_(pa.array(values[:0]).type))


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None behind the last."""
    yield from batches
    yield None
