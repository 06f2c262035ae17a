"""SentencePiece ids of texts for vocabularies of the merge type, and texts from ids.

Encoding follows an agenda of adjacent symbol pairs: a text starts as single characters, the pair whose joined piece has the highest score
is joined first (the leftmost of equals), its new neighbours enter the agenda, and so on until no joined pair is a piece. Characters that
are left without a piece become the ids of their UTF-8 bytes.

If no piece holds a space behind another character, no merge crosses the place before a run of spaces. Texts are cut there, and every
distinct segment is encoded once per task. Short segments run their agendas side by side in numpy, one merge of each a round; a long one has
a heap. New segments are compared with the sentencepiece library, batch by batch (``check``).

A null or empty text has no ids, and no ids give the empty text. Repeated rows and ids, null ids and extra columns are kept as they are; an
empty table gives an empty table. Texts of any length are encoded whole. As in the library, U+2581 counts as a space and comes back as one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from obsflow.llm.text import distinct_segments, lists, pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int32(2**31 - 1)

#: Segments of up to so many characters run their agendas side by side; longer ones use a heap.
SHORT = 32
#: So many short segments at a time.
SIDE_BY_SIDE = 16_384
#: A task forgets the segments it knows when they and their ids have so many bytes.
KNOWN_BYTES = 64 << 20


class Vocabulary:
    """Pieces, scores and joinable pairs of a model file. Spaces stand for U+2581 in all texts here."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            body = f.read()
        model.ParseFromString(body)
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies with byte fallback and without user-defined or unused pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that leave texts as they are")
        self.library = SentencePieceProcessor(model_proto=body)
        self.prefix = " " if rules.add_dummy_prefix else ""
        self.unknown = model.trainer_spec.unk_surface
        self.kinds = np.array([p.type for p in model.pieces], np.int8)
        self.texts = [p.piece.replace(SPACE, " ") for p in model.pieces]
        normal = {t: i for i, t in enumerate(self.texts) if self.kinds[i] == NORMAL}
        self.cuts = not any(" " in t.lstrip(" ") for t in normal)
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.texts[i][1:-1], 16)] = i

        # Symbols are piece ids, and numbers behind them for characters that only occur inside pieces.
        self.symbols = dict(normal)
        for c in sorted({c for t in normal for c in t} - normal.keys()):
            self.symbols[c] = len(self.texts) + len(self.symbols) - len(normal)
        self.inner = {i: t for t, i in self.symbols.items() if i >= len(self.texts)}
        self.of_character = np.full(0x110000, -1, np.int32)
        for t, i in self.symbols.items():
            if len(t) == 1:
                self.of_character[ord(t)] = i
        order = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.span = np.int64(len(self.texts) + len(self.symbols) + 1)
        joined = {}
        for t, i in normal.items():
            for k in range(1, len(t)):
                a, b = self.symbols.get(t[:k]), self.symbols.get(t[k:])
                if a is not None and b is not None:
                    joined[a * int(self.span) + b] = (order[model.pieces[i].score], i)
        self.pair_keys = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_pieces = np.array([joined[k][1] for k in self.pair_keys.tolist()], np.int32)
        self.joined = joined

    def places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs stand among the joinable ones, and whether they do."""
        if not len(self.pair_keys):
            return np.zeros(left.shape, np.int64), np.zeros(left.shape, bool)
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.span + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return at, self.pair_keys[at] == keys

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, known = self.places(left, right)
        return np.where(known, self.pair_ranks[at] if len(self.pair_ranks) else NONE, NONE)


def single_symbols(words: Vocabulary, text: str) -> np.ndarray:
    """The symbol of every character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = words.of_character[codes]
    return np.where(symbols >= 0, symbols, -1 - codes.astype(np.int32))


def merged_side_by_side(words: Vocabulary, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of all short texts in a row, and how many each has; characters unknown to all pieces are ``-1 - code point``."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(lengths.max(initial=0))
    if not width:
        return np.zeros(0, np.int32), lengths
    column = np.arange(width + 1)
    done = np.full((len(texts), width + 1), -1, np.int32)  # one column more, so that a row can always be shifted
    done[column < lengths[:, None]] = single_symbols(words, "".join(texts))
    S, size, row = done.copy(), lengths.copy(), np.arange(len(texts))
    R = np.full((len(texts), width), NONE, np.int32)
    R[:, : width - 1] = np.where(column[1:width] < lengths[:, None], words.ranks(S[:, : width - 1], S[:, 1:width]), NONE)
    while True:
        best = R.argmin(1)  # the first of equals is the leftmost
        going = R[np.arange(len(row)), best] != NONE
        if not going.all():
            done[row[~going]], lengths[row[~going]] = S[~going], size[~going]
            S, R, row, size, best = S[going], R[going], row[going], size[going], best[going]
        if not len(row):
            return done[column < lengths[:, None]], lengths
        every = np.arange(len(row))
        at, _ = words.places(S[every, best], S[every, best + 1])
        S[:, :-1] = np.where(column[:-1] > best[:, None], S[:, 1:], S[:, :-1])
        S[every, best] = words.pair_pieces[at]
        R[:, :-1] = np.where(column[: width - 1] > best[:, None], R[:, 1:], R[:, :-1])
        size -= 1
        left = np.maximum(best - 1, 0)
        near = words.ranks(np.stack([S[every, best], S[every, left]]), np.stack([S[every, best + 1], S[every, best]]))
        R[every, best] = np.where(best + 1 < size, near[0], NONE)
        R[every, left] = np.where(best > 0, near[1], R[every, left])


def merged_by_heap(words: Vocabulary, text: str) -> list[int]:
    """The symbols left of one text of any length."""
    symbol = single_symbols(words, text).tolist()
    n, span, joined = len(symbol), int(words.span), words.joined
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and symbol[a] >= 0 and symbol[b] >= 0 and (found := joined.get(symbol[a] * span + symbol[b])) is not None:
            agenda.append((found[0], a, b, symbol[a] * span + symbol[b], found[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    heapq.heapify(agenda)
    while agenda:
        _, a, b, pair, piece = heapq.heappop(agenda)
        if not alive[a] or not alive[b] or symbol[a] * span + symbol[b] != pair:
            continue  # one of the two has grown or gone since
        symbol[a], alive[b], after[a] = piece, False, after[b]
        if after[b] < n:
            before[after[b]] = a
        known = len(agenda)
        offer(before[a], a)
        offer(a, after[a])
        fresh = agenda[known:]
        del agenda[known:]
        for entry in fresh:
            heapq.heappush(agenda, entry)
    return [symbol[i] for i in range(n) if alive[i]]


class Encoder:
    """Encodes pieces of Arrow columns; every distinct segment goes through the agenda once per task."""

    def __init__(self, path: str, check: bool = True):
        self.words, self.check = Vocabulary(path), check
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def ids_of(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the symbols of several texts, and how many each text has; what is no piece goes as bytes."""
        other = np.flatnonzero((symbols < 0) | (symbols >= len(self.words.texts)))
        if not len(other):
            return symbols, counts
        spelled = [chr(-1 - s) if s < 0 else self.words.inner[s] for s in symbols[other].tolist()]
        as_bytes = [self.words.byte_ids[list(c.encode())] for c in spelled]
        width = np.ones(len(symbols), np.int64)
        width[other] = [len(x) for x in as_bytes]
        out = np.repeat(symbols, width)
        wide = np.zeros(len(symbols), bool)
        wide[other] = True
        out[np.repeat(wide, width)] = np.concatenate(as_bytes)
        bounds = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(bounds)

    def segments(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Segments with their ids, compared with the library."""
        texts = sorted(texts, key=len)
        short = next((i for i, t in enumerate(texts) if len(t) > SHORT), len(texts))
        for k in range(0, short, SIDE_BY_SIDE):
            some = texts[k : min(k + SIDE_BY_SIDE, short)]
            yield from self.packed(some, *merged_side_by_side(self.words, some))
        for t in texts[short:]:
            symbols = np.array(merged_by_heap(self.words, t), np.int32)
            yield from self.packed([t], symbols, np.array([len(symbols)]))

    def packed(self, texts: list[str], symbols: np.ndarray, counts: np.ndarray) -> Iterator[tuple[str, bytes]]:
        ids, counts = self.ids_of(symbols, counts)
        if self.check:
            self.compare(texts, ids, counts)
        body, bounds = ids.astype(np.int32, copy=False).tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        for t, lo, hi in zip(texts, bounds[:-1], bounds[1:], strict=True):
            yield t, body[lo:hi]

    def compare(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """The library puts a space before each text, so a lone space cannot be asked for."""
        lead = len(self.words.prefix)
        asked = np.array([len(t) > lead for t in texts])
        expected = self.words.library.encode([t[lead:] for t, a in zip(texts, asked, strict=True) if a], num_threads=1)
        same = np.array_equal(np.fromiter(map(len, expected), np.int64, len(expected)), counts[asked])
        if not same or not np.array_equal(np.fromiter(chain.from_iterable(expected), np.int32), ids[np.repeat(asked, counts)]):
            raise AssertionError(f"ids differ from the library's in one of the segments {texts[0][:200]!r} to {texts[-1][:200]!r}")

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece in a row, and their bounds by text."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, bool)
        if self.words.cuts:
            cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        found, which = distinct_segments(data, start)
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        new = [s for s in found if s not in self.known]
        for t, kept in self.segments([s.decode() for s in new]):
            s = t.encode()
            self.known[s] = kept
            self.size += len(s) + len(kept) + 150
        parts = [self.known[s] for s in found]
        flat = np.frombuffer(b"".join(parts), np.int32)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        low, size = (np.cumsum(length) - length)[which], length[which]
        before = np.cumsum(size) - size
        ids = flat[np.repeat(low - before, size) + np.arange(int(size.sum()))]
        return ids, np.concatenate([before, [len(ids)]])[np.searchsorted(start, offsets)]


def spaced(column: pa.Array, prefix: str) -> pa.Array:
    """Texts with U+2581 as spaces and the space before each that is not empty; a null is empty."""
    texts = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
    if not prefix:
        return texts
    led = pc.binary_join_element_wise(pa.scalar(prefix, pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, led)


def encode(docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",), check: bool = True) -> DataFrame:
    """``keep`` and ``tokens``, the ids of each text without begin or end ids. ``model`` is a path that every worker has."""
    chosen = docs.select(*keep, docs[text].alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "tokens array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, check)
        for batch in batches:
            for lo, hi, data, offsets in pieces(spaced(batch.column(len(keep)), encoder.words.prefix)):
                ids, bounds = encoder(data, offsets)
                kept = [c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, lists(ids, bounds)], names=[*keep, "tokens"])

    return chosen.mapInArrow(run, schema)


class Decoder:
    """Texts of ids as the library gives them."""

    def __init__(self, path: str):
        words = Vocabulary(path)
        self.kinds, self.prefix = words.kinds, words.prefix
        shown = [self.shown(words, i) for i in range(len(words.texts))]
        self.body = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.low = np.cumsum(self.size) - self.size
        self.spaced = np.array([t.startswith(" ") for t in words.texts]) & (self.kinds == NORMAL)

    @staticmethod
    def shown(words: Vocabulary, i: int) -> bytes:
        kind = words.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return words.unknown.encode()
        return bytes([int(words.texts[i][1:-1], 16)]) if kind == BYTE else words.texts[i].encode()

    def raw(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.body[np.repeat(self.low[ids] - before, size) + np.arange(int(size.sum()))].tobytes()

    def __call__(self, ids: np.ndarray) -> str:
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.size)):
            raise ValueError("an id outside the vocabulary")
        seen = np.flatnonzero(self.kinds[ids] != CONTROL)
        skip = int(bool(self.prefix) and len(seen) > 0 and bool(self.spaced[ids[seen[0]]]))
        try:
            return self.raw(ids).decode()[skip:]
        except UnicodeDecodeError:
            return self.mended(ids)[skip:]

    def mended(self, ids: np.ndarray) -> str:
        """Runs of byte ids that are no UTF-8 show U+FFFD for each byte that begins no character."""
        single = self.kinds[ids] == BYTE
        edges = np.flatnonzero(np.diff(single, prepend=~single[:1]))
        out = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True):
            body = self.raw(ids[lo:hi])
            while body and single[lo]:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(body[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                body = body[n:]
            out.append(body.decode())
        return "".join(out)


def decode(tokens: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), check: bool = True) -> DataFrame:
    """``keep`` and ``text`` of the ids in ``tokens``; null or no ids give the empty text. ``check`` compares with the library."""
    chosen = tokens.select(*keep, tokens["tokens"].alias("_tokens"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        decoder, library = Decoder(model), SentencePieceProcessor(model_file=model)
        for batch in batches:
            column = batch.column(len(keep)).cast(pa.large_list(pa.int32()))
            lo, step = 0, 256
            while lo < len(column):
                some = column.slice(lo, step)
                ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in some]
                texts = [decoder(x) for x in ids]
                if check:
                    for x, t in zip(ids, texts, strict=True):
                        if library.decode(x.tolist()) != t:
                            raise AssertionError(f"a text differs from the library's: {t[:200]!r}")
                kept = [c.slice(lo, step) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*keep, "text"])
                lo += step

    return chosen.mapInArrow(run, schema)
