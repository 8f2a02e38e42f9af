"""From raw documents to token ids, stage by stage. Each stage is written as Parquet and reread as the next one's documents.

Every stage takes any columns besides those of `documents` along, and handles what its operator handles: null columns, empty and very
long texts, repeated rows, empty tables (see the operators' notes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import exact_dedup, language_id, mixing, near_copies, pieces
from tallywright.llm.common import documents, fresh, stored

#: A text whose best cosine is no larger resembles no learned language; unrelated vectors of this many dimensions reach about 0.03.
CHANCE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learned from the documents themselves, go. A null `lang` is filled in."""
    prototypes = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    pred, score = fresh(docs, "lang_pred", "score")
    told = language_id.identified(docs, prototypes, names_out=(pred, score))
    # without a single labelled document there is nothing to reject by
    known = (F.col(pred) != language_id.UNKNOWN) & (F.col(score) > CHANCE) if prototypes else F.col("text").rlike(r"\p{L}")
    filled = F.coalesce(F.col("lang"), F.when(F.col(pred) != language_id.UNKNOWN, F.col(pred)))
    return told.where(known).withColumn("lang", filled).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more, directly or over others) the smallest doc_id stays."""
    return near_copies.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as piece ids, with the end of each piece in the bytes of the text and the digest of the text decoded from the ids."""
    return pieces.encoded(docs, decoded=True)


STAGES = [("language id", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("pieces", encode)]

#: SQL cannot express the first, third and last stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
