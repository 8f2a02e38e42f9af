"""Ids by different words against the library on whole texts."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywright.llm import token_coder

PARTS = ["a", "B", "don't", "'s", "'S", "'", "’", "1", "23", "²", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", " ", "é", "è", "À", "ß", "ž", "ا", "×", "÷", "中文", "🙂", "́", ".", ",", "!?", "(",
         "|>", "<|endoftext", "<|endoftext|>", "_", "-", "the", "\x00", "\x7f", "‍"]


@pytest.mark.parametrize("spelled", [False, True])
@pytest.mark.parametrize("stretch", [1 << 23, 200])
def test_ids_are_the_librarys(monkeypatch, spelled, stretch):
    monkeypatch.setattr(token_coder, "STRETCH", stretch)
    r = random.Random(stretch)
    texts = [None, "", " ", "\n", "a <|endoftext", "a |>b", " x" * 300] + ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(4000)]
    library = Tokenizer.from_file(token_coder.tokenizer_path())
    library.encode_special_tokens = spelled
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = token_coder.Encoder(Tokenizer.from_file(token_coder.tokenizer_path()), spelled)
    assert encoder.by_word
    for part in (slice(0, 2000), slice(2000, None), slice(0, 0)):  # the second time many words are known
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string())[part])] == want[part]


def test_library_is_asked_once_a_word(monkeypatch):
    encoder, asked = token_coder.Encoder(Tokenizer.from_file(token_coder.tokenizer_path())), []
    library = encoder.library
    monkeypatch.setattr(encoder, "library", lambda texts: asked.append(sum(map(len, texts))) or library(texts))
    texts = pa.array([" ".join(f"w{i % 50}x" for i in range(k, k + 400)) for k in range(100)])
    for _ in range(2):
        assert sum(map(len, encoder.encode(texts))) > 40_000
    assert sum(asked) < 1000


def test_other_tokenizers_get_whole_texts():
    from tokenizers import normalizers

    tokenizer = Tokenizer.from_file(token_coder.tokenizer_path())
    tokenizer.normalizer = normalizers.Lowercase()
    encoder = token_coder.Encoder(tokenizer)
    assert not encoder.by_word
    assert [i.tolist() for i in encoder.encode(pa.array(["The CAT", None]))] == [tokenizer.encode("the cat", add_special_tokens=False).ids, []]
