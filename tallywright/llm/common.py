"""Helpers shared by the operators: whole tables, the shared folder, word splitting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a class for Java patterns. `bytes.split()` in Python splits at the same six.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: `spark.checkpoint.dir`, or one beside the warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as a table in the shared folder and read it again: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of `df` has: the wanted ones with underscores put in front as far as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words (maximal runs without ASCII white space); null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.xxhash64(text)


def id_key(doc_id: Column) -> Column:
    """A join key that null identifiers have as well."""
    return F.coalesce(F.concat(F.lit("0"), doc_id.cast("string")), F.lit("1"))


def only_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` with a (doc_id, digest of the text) in `chosen`, each once, however often the row is repeated."""
    key, digest, nth = fresh(docs, "key", "digest", "nth")
    keyed = docs.withColumns({key: id_key(F.col(f"`{doc_id}`")), digest: text_digest(F.col(f"`{text}`"))})
    wanted = chosen.select(id_key(F.col("doc_id")).alias(key), F.col("digest").alias(digest))
    found = keyed.join(wanted, [key, digest], "left_semi")
    return (found.withColumn(nth, F.row_number().over(Window.partitionBy(key, digest).orderBy(key)))
            .where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))


def by_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`mapInArrow`, with this package's place told to local workers (on a cluster it is installed or shipped with the job)."""
    here, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), df.sparkSession.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (here, env.get("PYTHONPATH")) if p)
    return df.mapInArrow(run, schema)
