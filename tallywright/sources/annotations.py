"""Truth boxes of public forgery sets: CSV manifests, XML zones, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = "struct<regions:array<struct<shape_attributes:struct<x:double,y:double,width:double,height:double>,region_attributes:map<string,string>>>>"
ORIGINAL_AREA = "Original area"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with columns image, forged and 'forgery annotations'."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def manifest_boxes(manifest: DataFrame) -> DataFrame:
    """Boxes of forged images; areas marked as original are skipped, unreadable annotations give none."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace("forgery annotations", r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    parsed = F.from_json(literal, REGIONS, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    d = manifest.where(F.col("forged") == "1").select("image", F.explode(parsed["regions"]).alias("r"))
    d = d.where(F.coalesce(F.try_element_at("r.region_attributes", F.lit(ORIGINAL_AREA)), F.lit("")) != "yes")
    s = lambda f: F.col(f"r.shape_attributes.{f}")
    return d.select("image", s("x").alias("x0"), s("y").alias("y0"), (s("x") + s("width")).alias("x1"), (s("y") + s("height")).alias("y1"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """XML files with zone elements carrying x, y, width and height."""
    z = spark.read.format("xml").schema("_x DOUBLE, _y DOUBLE, _width DOUBLE, _height DOUBLE").option("rowTag", "zone").load(path)
    return z.select(F.input_file_name().alias("path"), F.col("_x").alias("x0"), F.col("_y").alias("y0"),
                    (F.col("_x") + F.col("_width")).alias("x1"), (F.col("_y") + F.col("_height")).alias("y1"))


def labelled_files(files: DataFrame) -> DataFrame:
    """Truth from the file name: ``-g.`` marks a genuine page."""
    return files.withColumn("forged", ~F.col("path").contains("-g."))


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return labelled_files(f.select("path", "length"))
