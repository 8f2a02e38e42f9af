"""Session construction and the few settings the jobs rely on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark 4.1 takes a union of parts that are dealt by the same keys as dealt by them, but adaptive execution may put the partitions of each
#: part together in its own way; a window or aggregate without another shuffle then misses rows. Results depend on this setting.
UNION_APART = ("spark.sql.unionOutputPartitioning", "false")


def build_session(app_name: str = "tallywright", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings results depend on (UTC) and the ones plans like (AQE)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config(*UNION_APART)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # large expressions build much faster
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or one beside the warehouse (shared as well) where none is named."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared")
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write what several steps read to the shared folder and read it back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """One side of a join with a row per document. The planner takes two narrow columns of a stage for their share of its compressed file,
    which is under its limit for broadcasts up to ten million documents, and the driver then holds them all."""
    return df.hint("merge")


def together(spark: SparkSession, *jobs: Callable) -> list:
    """Run jobs that do not need each other side by side: planning one and the last tasks of another leave no core idle. Results in order."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
