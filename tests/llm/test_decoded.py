"""The last stage of the pipeline decodes what it encodes, as the library does."""

import hashlib

import sentencepiece
from conftest import SF
from llm_rows import none, odd, schema  # noqa: F401

import corpus_pipeline
from tallywright.llm import pieces


def test_last_stage_decodes(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    short = odd.where("doc_id is not null and (n_chars is null or n_chars < 1000)").drop("digest")
    texts = {r.doc_id: r.text or "" for r in short.collect()}
    rows = corpus_pipeline.encode(spark, short, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(texts[r.doc_id])).encode("utf-8", "replace")).hexdigest()
