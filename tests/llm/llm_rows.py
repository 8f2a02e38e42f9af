"""Rows with everything that operators must survive, and the tables made of them."""

import pytest
from pyspark.sql import types as T

LONG = "Long words and more of them. " * 40_000
ROWS = [
    (1, "One two  three four five six seven.", "en", "a", 35),
    (2, "One two three\tfour five six seven.", "en", "a", 35),
    (2, "One two three\tfour five six seven.", "en", "a", 35),  # a row repeated as a whole
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", None, "b", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", None, len(LONG)),
    (None, "One two three four five six seven.", "en", "a", 34),
    (None, "No identifier, but a text of its own. It has two sentences.", "fr", "c", 59),
    (None, None, None, None, None),
    (8, "😀 ünïcödé — 中文字 \x00 end", "de", "a\nb", 24),
    (9, "9 9 9 9 !!! ### $$$", None, "b", 19),
]
#: Names that operators use inside or return.
CLASHES = ("kept", "keep_id", "digest", "norm", "key", "nth", "copy", "score", "lang_pred", "spread", "fp", "root", "size", "ids_", "Digest_", "IDS", "Ends", "n_tokens", "Removed", "n_sentences", "places", "same")


@pytest.fixture(scope="session")
def schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd(spark, schema):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    wide = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in CLASHES)])
    return spark.createDataFrame([(*r, *(f"{c}-{i}" for c in CLASHES)) for i, r in enumerate(ROWS)], wide).repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
