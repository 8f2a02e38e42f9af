"""Uploaded files as tables: bytes, type, byte facts, OCR words, positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright import schema as S


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder with name, size and SHA-256. Bytes stay in ``content``; drop it after :func:`byte_facts`."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return describe_uploads(f)


def describe_uploads(f: DataFrame) -> DataFrame:
    return f.select(
        "path", F.substring(F.regexp_extract("path", "[^/]+$", 0), 1, K.NAME_CHARS).alias("filename"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("kind"), "content")


def sniff(content: Column) -> Column:
    """File type by its first bytes, or null."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(5) == "255044462D", "pdf").when(head(3) == "FFD8FF", "jpeg").when(head(8) == "89504E470D0A1A0A", "png")
        .when(head(4).isin("49492A00", "4D4D002A"), "tiff")
        .when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp"))


def byte_facts(files: DataFrame) -> DataFrame:
    """Revision count, linearization and the document-information entries that stand uncompressed in the file.

    A ``meta`` map column, where supplied, wins over the bytes.
    """
    text = F.decode("content", "ISO-8859-1")
    entry = lambda key: F.nullif(F.regexp_extract("_text", r"/%s\s*\(((?:\\.|[^()\\])*)\)" % key, 1), F.lit(""))
    supplied = "meta" in files.columns
    value = lambda key, name: F.coalesce(F.try_element_at("meta", F.lit(name)), entry(key)) if supplied else entry(key)
    pdf = F.coalesce(F.col("kind"), F.lit("")) == "pdf"
    d = files.withColumn("_text", F.when(pdf, text))
    return d.select(
        *[c for c in files.columns if c not in ("content", "meta")],
        F.when(pdf, F.regexp_count("_text", F.lit("%%EOF"))).otherwise(1).alias("n_eof"),
        F.coalesce(F.substring("_text", 1, 2048).contains("/Linearized"), F.lit(False)).alias("linearized"),
        value("Producer", "producer").alias("producer"), value("Creator", "creator").alias("creator"),
        value("CreationDate", "creationDate").alias("created"), value("ModDate", "modDate").alias("modified"))


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Word-level OCR output as tab-separated text."""
    return spark.read.schema(S.OCR_WORDS).option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def ocr_spans(words: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Confident, non-blank words as spans in page units. ``words``: doc_id, page, span_no, left, top, width, height, conf, text."""
    k = F.lit(scale) if isinstance(scale, (int, float)) else scale
    d = words.where((F.col("conf") >= K.MIN_OCR_CONF) & (F.trim("text") != ""))
    return d.select("doc_id", "page", "span_no", F.trim("text").alias("text"), (F.col("left") * k).alias("x0"), (F.col("top") * k).alias("y0"),
                    ((F.col("left") + F.col("width")) * k).alias("x1"), ((F.col("top") + F.col("height")) * k).alias("y1"),
                    F.lit(None).cast("string").alias("font"), (F.col("height") * k).alias("size"))


def read_table(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    """A typed Parquet table; older files without newer columns give nulls for them."""
    return spark.read.schema(schema).options(**options).parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A relational table in key ranges. Column and filter pruning reach the database."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)
