"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source. Documents stand in a fixed order inside
their source (by size class, then by a digest of the identifier); one offset, drawn once for the source, is added to the prefix sum
of the expected copies, and a document is emitted once for each whole number that its stretch crosses. Since neighbours in the order
are of like size, the words taken come close to the target.

Prefix sums never run through a whole source in one task: rows are counted in cells (source, size class, digest range), of which a
source has at most CLASSES x RANGES, then class counts and range counts are summed up, and only the rows of one cell are ranked.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null identifier sorts as the text
'null'; repeated rows are separate documents; a source without words has target 0 and gives nothing; an empty table gives an empty
table; extra columns are carried along by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import documents, fresh, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
RANGE_BITS = 10


def unit(text: Column) -> Column:
    """A number in 0 .. 2^32 - 1 fixed by the text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """0 for none; else eight classes to each power of two."""
    bits = F.length(F.bin(size))
    return F.when(size == 0, F.lit(0)).otherwise(bits * 8 + F.floor(size * 16 / F.pow(F.lit(2.0), bits)).cast("int") - 8).cast("int")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One narrow row a document: doc_id, source, size and where it stands (source_key, size_class, digest, range)."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    digest = unit(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)))
    return (narrow.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))))
            .withColumn("size_class", size_class(F.col("size"))).withColumn("digest", digest)
            .withColumn("range", F.shiftright(F.col("digest"), 32 - RANGE_BITS)))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to rows (source_key, source_rows, source_size), one a source.

    A source gets its weight's part of `share` times all sizes, but no more than `most` times its own size; the excess goes to the
    others by weight until none is above. That level is the largest of the levels reached by capping the sources one by one, those
    with the least room for their weight first. One row a source, so the windows over all sources stay small.
    """
    by_name, all_rows = Window.orderBy("source_key"), Window.partitionBy()
    room = Window.orderBy("room", "source_key")
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = (per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("room", F.col("cap") / F.col("weight"))
              .withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    return ranked.select("source_key", "source_size", F.least("cap", F.max("level").over(all_rows) * F.col("weight")).alias("target"))


def decide(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of `sizes` with source_size, target and copies."""
    cell = ["source_key", "size_class", "range"]
    cells = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    classes = cells.groupBy("source_key", "size_class").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    sources = classes.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    ahead = lambda by, order: F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    class_start = (classes.select("source_key", "size_class", ahead(["source_key"], "size_class").alias("class_start"))
                   .join(targets(sources, weights, share, most), "source_key"))
    starts = (cells.select(*cell, ahead(["source_key", "size_class"], "range").alias("range_start"))
              .join(class_start, ["source_key", "size_class"])
              .select(*cell, (F.col("class_start") + F.col("range_start")).alias("start"), "source_size", "target"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "digest", "doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.col("source_key"), F.lit(SEED))) / F.lit(4294967296.0)
    crossed = lambda place: F.floor(F.col("rate") * place + F.col("offset"))
    return (narrow.withColumn("inside", inside).join(starts, cell)
            .withColumn("place", F.col("start") + F.col("inside")).withColumn("rate", rate).withColumn("offset", offset)
            .withColumn("copies", (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("long")))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken.

    Decisions are made on narrow rows and joined back by identifier, source and size. Rows that share all three stand next to each
    other in the order; `spread` lists how many copies each of them gets.
    """
    decided = decide(stored(sizes(docs, doc_id, text, source), "mix-sizes"), weights, share, most)
    k_id, k_source, k_size, spread, nth, copy = fresh(docs, "k_id", "k_source", "k_size", "spread", "nth", "copy")
    id_key = F.coalesce(F.concat(F.lit("0"), F.col(f"`{doc_id}`").cast("string")), F.lit("1"))
    source_key = F.when(F.col(f"`{source}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"`{source}`")))
    # the runs of one identifier share rate and offset, so first place and count are enough to know every row's copies
    runs = (decided.select(F.coalesce(F.concat(F.lit("0"), F.col("doc_id").cast("string")), F.lit("1")).alias(k_id),
                           F.col("source_key").alias(k_source), F.col("size").alias(k_size), "place", "rate", "offset")
            .groupBy(k_id, k_source, k_size).agg(F.struct(F.min("place").alias("first"), F.first("rate").alias("rate"), F.first("offset").alias("offset")).alias(spread)))
    keyed = docs.withColumns({k_id: id_key, k_source: source_key, k_size: word_count(F.col(f"`{text}`"))}).join(runs, [k_id, k_source, k_size])
    same = Window.partitionBy(k_id, k_source, k_size).orderBy(F.xxhash64(F.col(f"`{text}`")))
    place = F.col(f"{spread}.first") + F.col(nth) - 1
    crossed = lambda p: F.floor(F.col(f"{spread}.rate") * p + F.col(f"{spread}.offset"))
    copies = (crossed(place) - crossed(place - 1)).cast("int")
    return (keyed.withColumn(nth, F.row_number().over(same)).where(copies > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = stored(sizes(documents(spark, sf_dir).select("doc_id", "text", "source")), "mix-sizes")
    return decide(narrow).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || 'mix-1'), 1, 8))::BIGINT AS digest
    FROM documents),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 8 + ((size * 16) >> length(bin(size))) - 8 END AS cls, digest >> 22 AS rng FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cls, rng, size, digest, doc_id) AS place FROM c),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap, max(level) OVER () * weight) AS target,
             ('0x' || substr(md5(k || 'mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM p JOIN t USING (k)),
f AS (SELECT *, (floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM f
"""
