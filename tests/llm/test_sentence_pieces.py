import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from obsflow.llm import sentence_pieces
from obsflow.llm.text import pieces

from .conftest import ODD

TEXTS = ["", " ", "   ", "▁", " ▁x", "a\x00b", "日本語😀 " * 50, "x" * 5000, "ab" * 300 + "\n\t" * 40, "<s> </s> <0x0A> <unk>", "�퟿", " " * 100]
TEXTS += ["http://a.b/c?d=e&f=" * 20, "Hello  wörld\n\tfoo", "don't stop, 12345 !!! ???"]


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def encoder(model):
    return sentence_pieces.Encoder(model)


def encoded(encoder, texts):
    out = []
    for _, _, data, offsets in pieces(sentence_pieces.spaced(sentence_pieces.pa.array(texts, sentence_pieces.pa.string()), " ")):
        ids, bounds = encoder(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def drawn(rng, alphabet=" abcdefé▁\n\t.,;日😀e in tionthe"):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))


def test_ids_are_the_library_s(encoder, library):
    rng = random.Random(1)
    texts = TEXTS + [drawn(rng) for _ in range(3000)]
    assert encoded(encoder, texts) == library.encode(texts)


def test_both_agendas_agree(encoder):
    rng, words = random.Random(2), encoder.words
    texts = [drawn(rng)[:30].replace("▁", " ") for _ in range(500)]
    flat, counts = sentence_pieces.merged_side_by_side(words, texts)
    assert flat.tolist() == [s for t in texts for s in sentence_pieces.merged_by_heap(words, t)]
    assert counts.tolist() == [len(sentence_pieces.merged_by_heap(words, t)) for t in texts]


def test_forgetting_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KNOWN_BYTES", 200)
    rng = random.Random(3)
    texts = [drawn(rng) for _ in range(300)]
    encoder = sentence_pieces.Encoder(model)
    assert [encoded(encoder, [t])[0] for t in texts] == library.encode(texts)


def test_text_of_any_ids(model, library):
    rng, decoder = random.Random(4), sentence_pieces.Decoder(model)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, *range(3, 259), *range(259, 400), 29871, 31999]) for _ in range(rng.randint(0, 8))]
        assert decoder(np.array(ids, np.int32)) == library.decode(ids)
    with pytest.raises(ValueError, match="vocabulary"):
        decoder(np.array([32_000], np.int32))


def test_a_wrong_id_is_noticed(model):
    encoder = sentence_pieces.Encoder(model)
    encoder.words.pair_ranks = encoder.words.pair_ranks[::-1].copy()
    with pytest.raises(AssertionError, match="library"):
        encoded(encoder, ["a long conversation merged in another order"])


def test_other_kinds_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        sentence_pieces.Vocabulary(str(tmp_path / "unigram.model"))


def test_round_trip_of_odd_rows(llm, odd, clashing, none, model, library):
    expected = sorted((str(r[0]), library.encode(r[1] or "")) for r in ODD)
    for docs in (odd, clashing):
        tokens = sentence_pieces.encode(docs, model)
        assert sorted((str(r["doc_id"]), r["tokens"]) for r in tokens.collect()) == expected
        texts = sentence_pieces.decode(tokens, model, keep=["doc_id", "tokens"])
        assert sorted((str(r["doc_id"]), r["text"]) for r in texts.collect()) == sorted((str(r[0]), r[1] or "") for r in ODD)
    assert sentence_pieces.decode(sentence_pieces.encode(none, model), model).collect() == []


def test_null_ids_list_gives_the_empty_text(llm, model):
    df = llm.createDataFrame([(1, None), (2, [])], "doc_id long, tokens array<int>")
    assert [tuple(r) for r in sentence_pieces.decode(df, model).orderBy("doc_id").collect()] == [(1, ""), (2, "")]


def test_query_digests(llm, folder, library):
    import hashlib

    from obsflow.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in llm.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_agenda"](llm, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.lit(1)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
