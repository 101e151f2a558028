import random

import pytest
import sentencepiece

from tidecast.llm import piece_codec as P

EDGE = ["", " ", "a", "  a  b ", "a\tb\nc", "ﬁ ½ Å", "é", "a　b", "▁a", "\x00a", "a▁b", "ＡＢＣ", "😀x 😀😀",
        "a\r\n\r\nb", "<s> </s> <0x41>", " " * 40 + "x" + " " * 17, "x" * 500, "abcdefgh" * 300, "日本語のテキスト", "the " * 2000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_matches_library(library):
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefgh tionrse éüñ,.\n0123") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    vocabulary = P.Vocabulary.read()
    for texts in (EDGE, made):
        values, offsets = P.encode_batch(texts, vocabulary)
        for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
            assert values[a:b].tolist() == library.encode(t), t
            assert P.decode(values[a:b].tolist(), vocabulary) == library.decode(library.encode(t)), t


def test_units_met_before_are_not_indexed_again(library, monkeypatch):
    vocabulary, indexed = P.Vocabulary.read(), []
    whole = P.encode_units
    monkeypatch.setattr(P, "encode_units", lambda units, v: indexed.append(list(units)) or whole(units, v))
    batches = [["a rare word", "  b  c", ""], EDGE, ["word a", "c rare x😀"], [], ["b a"]]
    for most in (0, 3, 10_000):
        encoder = P.Encoder(vocabulary, most)
        indexed.clear()
        for texts in batches:
            values, offsets = encoder(texts)
            assert [values[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == library.encode(texts)
            assert len(encoder.known) == len(encoder.counts) and encoder.counts.sum() == len(encoder.values)
        met = [u for part in indexed for u in part]
        assert most < 10_000 or len(met) == len(set(met))
        assert most or not encoder.known.keys() - {"▁b", "▁a"}  # forgotten but for the last batch's


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = P.encode(docs)
    for r in encoded.collect():
        assert r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip
    assert {r.doc_id: r.text for r in P.decode_ids(encoded).collect()} == texts


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "z", 4), (2, "z", 5)],
                                 "doc_id long, text string, token_ids int")
    got = sorted(((r.doc_id, r.n_tokens, r.round_trip) for r in P.encode(docs).collect()), key=str)
    assert got == sorted([(None, 2, True), (1, 0, True), (1, 0, True), (2, 1, True), (2, 1, True)], key=str)
    assert P.encode(docs.limit(0)).count() == 0
