"""Repeated passages of over 50 words whatever their sentences are like."""

import pytest

from tallywright.llm import sentence_spans

SHORT = "\n".join(f"Line {i} here." for i in range(20))  # 60 words, no two lines with twenty together
LONG = "One sentence " + " ".join(f"w{i}" for i in range(60)) + " ends."


def test_short_and_long_sentences(spark):
    docs = spark.createDataFrame([
        (1, f"Own start of the first.\n{SHORT}\nOwn end."), (2, f"Another beginning.\n{SHORT}\nAnd another end to it."),
        (3, f"What stands before. {LONG} What follows."), (4, f"Something else. {LONG} And more."), (5, f"{LONG}"),
    ], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_spans.cleaned(docs).collect()}
    assert got[1].count("Line") == 20 and got[3].count("w59") == 1
    # at most the last lines, fewer words than a run, may stay with what follows them
    assert got[2].startswith("Another beginning.") and got[2].endswith("And another end to it.") and got[2].count("Line") <= 3
    assert got[4] == "Something else. And more." and got[5] == ""


def test_a_short_sentence_after_a_long_one_goes_as_before():
    text = "This one sentence has quite a few more words in it than a run must have, it has, so it goes. Short one."
    found = sentence_spans.runs(text, sentence_spans.sentences(text))
    assert [divmod(p, sentence_spans.PLACE) for p, _ in found] == [(0, 0), (0, 1)]


def test_chance_repeats_of_a_sentence_stay(spark):
    docs = spark.createDataFrame([(1, "A saying of twelve words that many an author has used before now. Mine."), (2, "Before it. A saying of twelve words that many an author has used before now.")],
                                 "doc_id long, text string")
    assert sentence_spans.cleaned(docs).where("size(removed) > 0").count() == 0


def test_runs_that_places_cannot_hold():
    with pytest.raises(ValueError, match="at most"):
        sentence_spans.runs("a", [(0, 1)], least_words=sentence_spans.PLACE + 1)
