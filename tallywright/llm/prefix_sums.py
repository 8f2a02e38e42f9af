"""Running sums inside keys, one of which may own a large share of the rows.

Rows are range-partitioned by key and order, so a key of any size is cut wherever its share of a partition ends; sums run inside each
cut, and one row for each cut of a key that has several carries the sums before it. At most one key passes from one partition to the
next, so these rows are fewer than twice the partitions and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import stored


def with_running(df: DataFrame, key: str, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """`df` with each of `sums` added up to and with the row itself. Rows that tie in key and order must be alike in `sums`."""
    ranged = stored(df.repartitionByRange(F.col(key), *order).withColumn("_cut", F.spark_partition_id()), name)
    inside = Window.partitionBy("_cut", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = ranged.groupBy(F.col(key).alias("_key"), "_cut").agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    several = Window.partitionBy("_key").orderBy("_cut")
    ahead = cuts.select("_key", "_cut", *[F.sum(f"_of_{n}").over(several.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}") for n in sums])
    ahead = ahead.where(F.col(f"_before_{next(iter(sums))}").isNotNull()).withColumnRenamed("_cut", "_at")
    summed = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    found = summed.join(F.broadcast(ahead), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cut") == F.col("_at")), "left")
    return found.withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}).drop("_cut", "_key", "_at", *[f"_before_{n}" for n in sums])
