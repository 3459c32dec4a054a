"""Encoding, decoding and spans against the public library."""

import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from shelfsense.llm import pieces  # noqa: E402

TEXTS = ["", " ", "a", "  a  b ", "x\ty\nz", "▁a ▁▁ b", "é😀 中文字", "a\x00b", "<s>x</s> <unk> <0x41>",
         "Thing the and  of   to\n\n  be", "ab" * 700, " " * 90, "naïve ﬁ Ａ ½ ｶﾞ", "​﻿ x   y", "�"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def _patched(model: bytes, spec: bytes) -> bytes:
    """The model with another normaliser (field 3)."""
    out = bytearray()
    for number, value in pieces._fields(model):
        if number in (1, 2):
            out += _message(number, value)
    return bytes(out + _message(3, spec))


def _message(number: int, value: bytes) -> bytes:
    size, n = b"", len(value)
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return bytes([number << 3 | 2]) + size + value


def _check(blob: bytes, texts):
    codec = pieces.PieceCodec(blob)
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in texts:
        ids = library.encode(text, add_eos=True)
        made = codec.encode(text)
        assert made.ids == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids), repr(text)
        quick = codec.arrays(text)
        assert quick[0].tolist() == ids and quick[3] == library.decode(ids)
        assert quick[1].tolist() == made.spans[:, 0].tolist() and quick[2].tolist() == made.spans[:, 1].tolist()
        n, ids_sha, decoded_sha, spans_sha = codec.digest(text)
        assert n == len(ids)
        assert ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert spans_sha == hashlib.sha256(made.spans[:, 0].astype("int32").tobytes()).hexdigest()
        theirs = library.encode(text, return_type="proto")
        source = text.encode()
        for (begin, end), p in zip(made.spans.tolist(), theirs.pieces):
            assert (begin, end) == (p.begin, p.end), (text, p.piece)
            assert source[begin:end].decode("utf-8") == p.surface


def test_identity_model(model):
    _check(model, TEXTS)


def test_whole_documents(model, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.digest_documents(docs, model).collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for row in docs.collect():
        ids = library.encode(row.text or "", add_eos=True)
        mine = got[row.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_map(model, rule):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(pieces._fields(normalizer.serialized_model_proto()))[3]
    flags = b"".join(bytes([n << 3, 1]) for n in (3, 4, 5))
    charsmap = dict(pieces._fields(spec))[2]
    blob = _patched(model, _message(2, charsmap) + flags)
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    codec = pieces.PieceCodec(blob)
    for text in TEXTS:
        ids = library.encode(text, add_eos=True)
        made = codec.encode(text)
        assert made.ids == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids), repr(text)
        theirs = library.encode(text, return_type="proto")
        for (begin, end), p in zip(made.spans.tolist(), theirs.pieces):
            assert (begin, end) == (p.begin, p.end), (text, p.piece)


def test_rows_and_columns(model, spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", None), (None, "", "y")], "doc_id long, text string, ids string")
    rows = pieces.encode_documents(docs, model).collect()
    assert sorted(r.decoded for r in rows) == ["", "", "a b"]
    assert pieces.digest_documents(docs, model).count() == 3
    assert pieces.digest_documents(docs.limit(0), model).count() == 0
    codec = pieces.PieceCodec(model)
    for r in rows:
        made = codec.encode(r.text)
        assert (r.ids, r.span_begins, r.span_ends) == (made.ids, made.spans[:, 0].tolist(), made.spans[:, 1].tolist())


def test_words_in_use_are_not_forgotten(model):
    codec = pieces.PieceCodec(model, remember=6)
    merged = []
    one_by_one = codec.merge
    codec.merge = lambda word: merged.append(word) or one_by_one(word)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the mat and the log"]
    for at in range(0, len(texts), 2):
        for text, words in codec.read(texts[at:at + 2], most=30):
            assert codec.digest(text, words) == pieces.PieceCodec(model).digest(text)
    assert not merged  # new words, and known ones after a clearing, are merged together
