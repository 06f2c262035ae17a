"""Hashed presence features of whole texts: words, word beginnings, and bins of style ratios."""

from __future__ import annotations

import numpy as np

from obsflow.llm.text import IS_SPACE, LETTERS, STEP, Hasher, mix, word_spans

BITS = 18
SIZE = 1 << BITS
BEGINNINGS = (4, 5)
_SHIFT = np.uint64(64 - BITS)

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>{}[]\\^~=_"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and of the beginnings of longer words."""
    folded = LETTERS[data]
    start, end, text = word_spans(folded != 32, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher = Hasher(folded)
    found, where = [hasher(start, end)], [text]
    for n in BEGINNINGS:
        longer = end - start > n
        found.append(mix(hasher(start[longer], start[longer] + n) + np.uint64(n * STEP & (1 << 64) - 1)))
        where.append(text[longer])
    return (np.concatenate(found) >> _SHIFT).astype(np.int64), np.concatenate(where)


def style_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of binned shares of symbols, capitals, digits and of words that repeat the one before."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    start, end, text = word_spans(~IS_SPACE[data], offsets)
    again = np.zeros(n)
    if len(start):
        h = Hasher(data)(start, end)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        again = np.bincount(text, same, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
    upper, lower = share(_upper[data]), share(_lower[data])
    ratios = [share(_symbol[data]), upper / np.maximum(upper + lower, 1e-9), share(_digit[data]), again]
    names = [mix((np.uint64(100 * (i + 1)) + np.minimum(10 * r, 9).astype(np.uint64)) * np.uint64(STEP)) for i, r in enumerate(ratios)]
    return (np.concatenate(names) >> _SHIFT).astype(np.int64), np.tile(np.arange(n), len(ratios))


def present(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(bucket, text)`` in the order of texts; only buckets marked in ``used``, if given."""
    parts = [word_features(data, offsets), style_features(data, offsets)]
    bucket, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    if used is not None:
        some = used[bucket]
        bucket, text = bucket[some], text[some]
    both = np.unique(text << BITS | bucket)
    return both & (SIZE - 1), both >> BITS
