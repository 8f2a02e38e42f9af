"""Where results go: reports, audit trail, models, and rows that could not be processed."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.findings import severity_rank


def build_reports(documents: DataFrame, scores: DataFrame, findings: DataFrame, today: str) -> DataFrame:
    """One row per document with its scores and a bounded summary; findings stay a table of their own."""
    n = findings.groupBy("doc_id").agg(
        F.count("*").alias("findings"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.array_sort(F.collect_set("code")).alias("codes"))
    d = documents.join(scores, "doc_id").join(n, "doc_id", "left")
    return d.withColumn("findings", F.coalesce("findings", F.lit(0))).withColumn("analyzed_on", F.lit(today))


def write_reports(reports: DataFrame, path: str, run: str = "batch") -> None:
    """Add a run's reports. Run once more, it replaces what it wrote for that day before."""
    reports.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analyzed_on", "run").parquet(path)


def report_view(reports: DataFrame) -> DataFrame:
    """A stored report without its feature vector."""
    return reports.drop("features", "run")


def split_failed(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantine). A document that cannot be processed yields an unreadable report; none is lost."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = rows.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("no value: "), F.array_join(missing, ", "))))
    failed = marked.where(F.col("error").isNotNull()).select(
        "doc_id", F.lit("error").alias("status"), F.lit("unreadable").alias("verdict"), F.lit(0).alias("risk"), F.lit("Could not be processed").alias("headline"),
        "error", F.lit("A second run; a document that fails twice needs to be looked at.").alias("needs"))
    return marked.where(F.col("error").isNull()).drop("error"), failed


CORRUPT = "_corrupt"


def read_uploads_log(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Upload records in JSON lines, all values as text, with the line itself in `_corrupt` where it is no record. Nothing is dropped."""
    schema = ", ".join(f"`{f}` STRING" for f in fields) + f", `{CORRUPT}` STRING"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def typed_or_failed(records: DataFrame, fields: dict[str, str], required: list[str], kinds: list[str] | None = None, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(typed rows, unreadable reports): every record is in one of the two.

    A record fails when its line is broken, a value is no value of its type, a required one is missing, or its kind is unknown. A report
    carries the identifier where one could be read, the reasons in that order, and the line where nothing else is known.
    """
    cast = {f: F.col(f).try_cast(t) for f, t in fields.items()}
    bad = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & cast[f].isNull(), F.concat(F.lit(f"{f} is no {t}: "), F.col(f))) for f, t in fields.items() if t != "string"]))
    gone = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))
    kind = F.lit(None).cast("string") if kinds is None else F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(kinds), F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("none"))))
    broken = F.when(F.col(CORRUPT).isNotNull(), F.lit("broken record"))
    reasons = F.when(broken.isNotNull(), F.array(broken)).otherwise(F.concat(
        bad, F.when(F.size(gone) > 0, F.array(F.concat(F.lit("no value: "), F.array_join(gone, ", ")))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(kind))))
    marked = records.withColumn("_why", F.array_join(reasons, "; "))
    typed = marked.where(F.col("_why") == "").select(*[cast[f].alias(f) for f in fields])
    failed = marked.where(F.col("_why") != "").select(
        cast[doc_id].alias("doc_id"), F.lit("error").alias("status"), F.lit("unreadable").alias("verdict"), F.lit(0).alias("risk"), F.lit("Could not be processed").alias("headline"),
        F.col("_why").alias("error"), F.col(CORRUPT).alias("record"), F.lit("A second run; a document that fails twice needs to be looked at.").alias("needs"))
    return typed, failed


def audit_rows(events: DataFrame, action: str, target: str, detail=None) -> DataFrame:
    return events.select("org_id", "user_id", F.lit(action).alias("action"), F.col(target).cast("string").alias("target"),
                         (F.lit("") if detail is None else detail).alias("detail"), "at")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str, defaults: dict) -> DataFrame:
    """A table whose newer files have more columns; rows from before take the defaults."""
    d = spark.read.option("mergeSchema", "true").parquet(path)
    for c, v in defaults.items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in d.columns else F.lit(v))
    return d


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def model_versions(spark: SparkSession, store: str) -> DataFrame | None:
    """The manifests of a model store: version, base_rows, labelled_rows, features, trained_at, path. Null when there is none."""
    if not _exists(spark, f"{store}/manifest"):
        return None
    return spark.read.schema("version long, base_rows long, labelled_rows long, features array<string>, trained_at timestamp, path string").parquet(f"{store}/manifest/*")


def add_model_version(model: PipelineModel, store: str, spark: SparkSession, base_rows: int, labelled_rows: int, features: list[str]) -> int:
    """Write a model aside, then its manifest, which is what readers go by: a job that fails before that leaves the last version in place."""
    known = model_versions(spark, store)
    version = 1 + (0 if known is None else known.agg(F.max("version")).first()[0])
    path = f"{store}/models/{version:06d}-{uuid.uuid4().hex}"
    model.write().save(path)
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(base_rows).cast("long").alias("base_rows"), F.lit(labelled_rows).cast("long").alias("labelled_rows"),
                                F.array(*[F.lit(f) for f in features]).alias("features"), F.current_timestamp().alias("trained_at"), F.lit(path).alias("path"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{version:06d}")
    return version


def load_newest_model(spark: SparkSession, stored: str, bundled: str | None = None) -> PipelineModel | None:
    """A retrained model wins over the bundled one; null when there is none. `stored` is a model store, or the folder of one model."""
    versions = model_versions(spark, stored)
    if versions is not None:
        return PipelineModel.load(versions.agg(F.max_by("path", "version")).first()[0])
    return next((PipelineModel.load(path) for path in (stored, bundled) if path is not None and _exists(spark, path)), None)
