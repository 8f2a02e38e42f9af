"""Token files and piece encoding against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from conftest import SF
from llm_rows import LONG, ROWS, none, odd, schema  # noqa: F401
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from tallywright.llm import pieces, token_coder


def odd_texts(alphabet, n=1500):
    rnd = random.Random(7)
    return ["", " ", "  "] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 5000, 300_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 50_257, n), np.arange(n) % 300 * 7)
    block = token_coder.write_block([5, None], np.array([n // 2, n - n // 2]), ids, 50_257)
    docs, lengths, back = token_coder.read_block(block)
    assert docs == [5, None] and lengths.sum() == n and (back == ids).all()


def test_coder_extremes_and_damage():
    same, rising = np.full(70_000, 9), np.arange(70_000) % 60_000
    for ids, vocabulary in ((same, 10), (rising, 60_000), (np.zeros(10, int), 1), (np.array([(1 << 18) - 1]), 1 << 18)):
        assert (token_coder.read_block(token_coder.write_block([1], np.array([len(ids)]), ids, vocabulary))[2] == ids).all()
    assert len(token_coder.write_block([1], np.array([70_000]), same, 10)) < 7000
    block = bytearray(token_coder.write_block([1], np.array([70_000]), rising, 60_000))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_coder.read_block(bytes(block))
    with pytest.raises(ValueError, match="vocabulary"):
        token_coder.write_block([1], np.array([1]), np.array([10]), 10)


SPECIAL = [(100, "before <|endoftext|> after"), (101, "<|endoftext|>"), (102, "a<|endoftext|>b <|endoftext|>\n<|endoftext")]


def library_ids(texts, special_as_text=False):
    t = Tokenizer.from_file(token_coder.tokenizer_path())
    t.encode_special_tokens = special_as_text
    return [t.encode(x or "", add_special_tokens=False).ids + [token_coder.END_ID] for x in texts]


def expected_files(rows):
    at, out = 0, []
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, odd, none, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = token_coder.op4_token_files(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == expected_files(rows)
    monkeypatch.setattr(token_coder, "BLOCK", 1000)
    out = token_coder.decode_files(token_coder.encode_files(odd)).collect()
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in ROWS), key=lambda d: (d is None, d or 0))
    assert sorted(map(tuple, (r.ids for r in out))) == sorted(map(tuple, library_ids([r[1] for r in ROWS])))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:], strict=False))
    assert token_coder.decode_files(token_coder.encode_files(none)).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_special_strings_in_texts(spark, special_as_text):
    """Special strings are what the library makes of them, or plain text where that is asked for."""
    blocks = token_coder.encode_files(spark.createDataFrame(SPECIAL, "doc_id long, text string"), special_as_text=special_as_text)
    got = {r.doc_id: list(r.ids) for r in token_coder.decode_files(blocks).collect()}
    assert got == dict(zip([d for d, _ in SPECIAL], library_ids([t for _, t in SPECIAL], special_as_text), strict=True))
    assert (50256 in got[100]) != special_as_text


def test_long_texts_are_cut_where_ids_do_not_change(monkeypatch):
    monkeypatch.setattr(token_coder, "PIECE", 5)
    t = Tokenizer.from_file(token_coder.tokenizer_path())
    for special_as_text in (True, False):
        t.encode_special_tokens = special_as_text
        for x in [*odd_texts(" \n\t\r ab'sé中😀12!?<|endoftext|>\xa0"), *(s for _, s in SPECIAL), "ab <|endoftext|> <|endoftext|>  cd\n<|endoftext|>\n" * 3]:
            assert [i for p in token_coder.parts_of(x) for i in t.encode(p, add_special_tokens=False).ids] == t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The vocabulary with its own rules, and with those of a compiled character map."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    return pieces.PieceModel(pieces.model_path()), pieces.PieceModel(str(path))


@pytest.mark.parametrize("piece", [1_000_000, 7])
@pytest.mark.parametrize("mapped", [0, 1])
def test_pieces_and_spans_as_the_library_gives_them(models, mapped, piece, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", piece)
    model = models[mapped]
    for t in odd_texts(" ▁ab\t\n\r\x00é中😀́�ﬁ①Ａｶﾞ가각㍿…½ﷺ　\xa0​﻿ the of 12<s></s>"):
        ids, ends = model.encode(t)
        want = model.library.encode(t, return_type="proto").pieces
        assert ids == [p.id for p in want]
        assert all(model.library.is_byte(p.id) or p.end == e for p, e in zip(want, ends, strict=True))


def test_piece_digests(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op6_pieces(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest() and r.covered_bytes == len(texts[r.doc_id].encode())
    out = pieces.encoded(odd).collect()
    assert sorted(map(str, (r.ids for r in out))) == sorted(str(sp.encode(r[1] or "")) for r in ROWS)
    assert next(r for r in out if r.doc_id == 6).ends[-1] == len(LONG)
    assert pieces.digests(odd).count() == len(ROWS) and pieces.encoded(none).count() == 0 and pieces.digests(none).count() == 0
