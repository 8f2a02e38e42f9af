"""Exact deduplication by a content sort.

Normalised texts are dealt into ranges between sampled splitters, sorted outside memory inside each range, and equal texts, now
adjacent, are found by comparing neighbours in full; of equal texts the smallest identifier stays.

The sort key starts with a bounded piece of the text and a digest of all of it, so splitters stay small however long a text is,
and the full text follows as the last key, so that a digest alone never decides. A text with more than 1/65536 of all rows (found
in a sample; at most 65536 such texts) is dealt out further by identifier, and its parts are put together by a map-side combined
aggregate over the full text. The sample only decides how work is dealt out, never the result.

Defined cases: a null text counts as empty; null identifiers sort last, and a group of only null identifiers keeps one row with
`keep_id` null; rows with equal text and equal identifier are one group, of which exactly one row is kept; an empty table gives an
empty table; extra columns are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import SPACE, documents, fresh, stored

#: One row in so many is looked at to find texts that many rows share.
SAMPLE_EVERY = 64
#: A text is dealt out further if at least one row in so many has it, into parts of about PART_ROWS rows.
HOT_SHARE = 65_536
PART_ROWS = 20_000
#: Inputs too small for that are dealt in parts of about one row in so many.
LEAST_PARTS = 512


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def hot_texts(df: DataFrame, digest: str, doc_id: str) -> DataFrame:
    """(digest, parts) of texts that a large share of the rows have, at most HOT_SHARE rows."""
    sample = df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id), F.monotonically_increasing_id()), F.lit(SAMPLE_EVERY)) == 0)
    counts = sample.groupBy(digest).agg(F.count(F.lit(1)).alias("in_sample"))
    total = counts.agg(F.sum("in_sample").alias("all_in_sample"))
    per_part = F.greatest(F.lit(1.0), F.least(F.lit(float(PART_ROWS)), F.col("all_in_sample") * SAMPLE_EVERY / LEAST_PARTS))
    return (counts.join(F.broadcast(total))  # one row
            .where((F.col("in_sample") >= 4) & (F.col("in_sample") * HOT_SHARE >= F.col("all_in_sample")))
            .select(digest, F.ceil(F.col("in_sample") * SAMPLE_EVERY / per_part).alias("parts"))
            .where("parts > 1").orderBy(F.desc("parts"), digest).limit(HOT_SHARE))


def mark_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows of `df` with keep_id, group_size, kept and text_sha256 (of the normalised text).

    `keep_text=False` leaves the text column out, so that only the normalised text is shuffled. A column of `df` that already has one
    of the four names gives way to the new one.
    """
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    norm, digest, head, part, parts, least, size, place, all_least, all_size = fresh(
        df, "norm", "digest", "head", "part", "parts", "least", "size", "place", "all_least", "all_size")
    carried = [c for c in df.columns if keep_text or c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in carried], normalised(F.col(f"`{text}`")).alias(norm)).withColumn(digest, F.xxhash64(norm))
    key = F.col(f"`{doc_id}`")
    hot = stored(hot_texts(rows.select(key.alias("id"), digest), digest, "id").withColumnRenamed("parts", parts), "hot-texts")

    # every hot text in one piece: combined before the shuffle, so each task sends one row a text
    whole = (rows.select(key.alias("id"), norm, digest).join(F.broadcast(hot), digest)
             .groupBy(digest, norm).agg(F.min("id").alias(all_least), F.count(F.lit(1)).alias(all_size),
                                       F.first(F.sha2(norm, 256)).alias("text_sha256"))
             .select(digest, "text_sha256", all_least, all_size))  # at most one row a hot text

    dealt = (rows.join(F.broadcast(hot), digest, "left")
             .withColumn(head, F.substring(norm, 1, 24))
             .withColumn(part, F.pmod(F.xxhash64(key), F.coalesce(parts, F.lit(1)).cast("long")))
             .repartitionByRange(head, digest, part))
    # the range partitioning on (head, digest, part) serves the window; its external sort brings equal texts together
    neighbours = Window.partitionBy(head, digest, part, norm).orderBy(key.asc_nulls_last())
    group = neighbours.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = (dealt.withColumn(place, F.row_number().over(neighbours))
                   .withColumn(least, F.first(key).over(group)).withColumn(size, F.count(F.lit(1)).over(group))
                   .withColumn("text_sha256", F.sha2(norm, 256)).drop(norm, head, part, parts))
    keep, count = F.coalesce(all_least, least), F.coalesce(all_size, size)
    return sorted_rows.join(F.broadcast(whole), [digest, "text_sha256"], "left").select(
        *[F.col(f"`{c}`") for c in carried], keep.alias("keep_id"), count.alias("group_size"),
        ((F.col(place) == 1) & keep.eqNullSafe(key)).alias("kept"), F.col("text_sha256"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `df`; those travel as one struct, so no name of theirs can clash."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("words"))
    return mark_duplicates(packed, "id", "words", keep_text=False).where("kept").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256 FROM n JOIN g USING (norm)
"""
