"""Every stage of the pipeline on odd and empty tables, and the whole of it against slow versions of its stages."""

import re

import pytest
import sentencepiece
from conftest import SF
from llm_rows import none, odd, schema  # noqa: F401
from test_near_copies import kept_by_brute

import corpus_pipeline
from tallywright.llm import mixing, pieces

KEEPS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_and_empty_tables(spark, odd, none, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    assert stage(spark, none, SF).count() == 0


def test_last_stage_on_odd_and_empty_tables(spark, odd, none):
    """Columns that are called like those the stage adds, in whatever case, come along."""
    out = corpus_pipeline.encode(spark, odd, SF)
    assert out.columns == [c for c in odd.columns if c != "text"] + ["_n_tokens", "_ids", "_ends", "decoded_sha256"]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r._n_tokens == len(r._ids) == len(r._ends) for r in rows)
    assert corpus_pipeline.encode(spark, none, SF).count() == 0


def test_language_stage_drops_texts_without_letters(spark, odd):
    stay = {r.doc_id for r in corpus_pipeline.language(spark, odd, SF).collect()}
    assert {1, 2, 6} <= stay and not stay & {3, 4, 5, 9}


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        if any(c.isalpha() for c in r.text or ""):
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    left = list(first.values())
    stay = kept_by_brute([(r.doc_id, r.text) for r in left])
    assert 0 < len(stay) < len(left)
    left = [r for r in left if r.doc_id in stay]
    copies = {r.doc_id: r.copies for r in mixing.decide(mixing.sizes(spark.createDataFrame(left))).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((r.doc_id, sp.encode(r.text)) for r in left for _ in range(copies[r.doc_id]))
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "mixing", "pieces"]
