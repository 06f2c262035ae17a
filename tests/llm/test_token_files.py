import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsflow.llm import token_files
from obsflow.llm.text import pieces

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")
ENCODER = token_files.Encoder(PATH)


def plain(texts):
    return [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_segments(texts):
    out = []
    for _, _, data, offsets in pieces(pa.array(texts, pa.string())):
        ids, counts = ENCODER(data, offsets)
        at = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sté ×É.,;!?\n\t\r \x1c　 1²日<|>", max_size=30), min_size=1, max_size=6))
def test_segments_give_the_tokenizers_ids(texts):
    assert by_segments(texts) == plain(texts)


def test_strings_made_to_share_a_polynomial_hash():
    """The Thue-Morse word and its complement have one hash modulo 2**64, whatever the base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"x {word} y", f"x {other} y"]
    assert by_segments(texts) == plain(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 200)
    texts = ["one two three", "four five six seven", "one two", "<|endoftext|> x"]
    assert [by_segments([t])[0] for t in texts] == plain(texts)


def test_round_trip(odd, tmp_path):
    token_files.write_tokens(odd, str(tmp_path / "t"), PATH)
    rows = token_files.read_tokens(odd.sparkSession, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.tokens) and r.tokens[-1] == 2
        at += r.n_tokens
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r.tokens == [*plain([texts[r.doc_id]])[0], 2]
    sums = token_files.checksums(token_files.read_tokens(odd.sparkSession, str(tmp_path / "t"))).collect()
    assert {(r.start, r.ids_crc32) for r in sums} == {(r.start, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) for r in rows}
    assert token_files.read_index(odd.sparkSession, str(tmp_path / "t")).count() == len(rows)


def test_file_layout(llm, tmp_path):
    docs = llm.createDataFrame([(i, f"text number {i} " * 200) for i in range(2000)], "doc_id long, text string").coalesce(1)
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, row_group_bytes=20_000, page_rows=20)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_row_groups for m in meta) > len(files)
    column = meta[0].row_group(0).column(4)
    assert column.path_in_schema.startswith("tokens") and "RLE_DICTIONARY" in column.encodings and column.has_column_index and column.has_offset_index
    one = pq.read_table(tmp_path / "t", columns=["doc_id", "n_tokens"], filters=[("doc_id", "==", 7)])
    assert one.num_rows == 1


def test_empty(none, tmp_path):
    token_files.write_tokens(none, str(tmp_path / "t"), PATH)
    assert token_files.checksums(token_files.read_tokens(none.sparkSession, str(tmp_path / "t"))).count() == 0
