"""Where a stream of batches keeps its results: tables bucketed by application, and a log that says what counts.

Every batch writes its tables aside, under a name of the attempt, and only then adds one line to the log. Readers open what the log
names and nothing else, so a batch that failed half-way, or is run again after it was logged, changes nothing. Tables lie in folders by
a hash of the application: a batch opens the buckets of the applications it touched, and of those only their own rows are compared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "run long, key string, whole boolean, tables map<string,string>, schemas map<string,string>"


@dataclass(frozen=True)
class Batch:
    """One batch while it writes: its number, its key, and what it has written so far."""
    run: int
    key: str
    tables: dict[str, str]
    schemas: dict[str, str]


@dataclass(frozen=True)
class Store:
    root: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("app_id"), F.lit(self.buckets)).cast("int")

    # --- the log -----------------------------------------------------------

    def log(self, spark: SparkSession) -> list:
        """Logged batches in order, from the last one that replaced all before it."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        lines = sorted(spark.read.schema(LOG).json(f"{self.root}/log/*").collect(), key=lambda r: r.run)  # one line a batch
        start = max((i for i, r in enumerate(lines) if r.whole), default=0)
        return lines[start:]

    def keys(self, spark: SparkSession) -> set[str]:
        return {k for r in self.log(spark) for k in json.loads(r.key)}

    def open(self, spark: SparkSession, key: str) -> Batch | None:
        """A batch to write, or None where one with this key is logged already."""
        log = self.log(spark)
        if any(key in json.loads(r.key) for r in log):
            return None
        return Batch(1 + max((r.run for r in log), default=0), key, {}, {})

    def write(self, batch: Batch, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of the batch (it needs app_id) and read it back."""
        spark, path = rows.sparkSession, f"{self.root}/{name}/run={batch.run}/attempt={uuid.uuid4().hex}"
        # rebalancing keeps a bucket's rows together but splits a bucket that one application fills
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        batch.tables[name], batch.schemas[name] = path, rows.schema.json()
        return spark.read.schema(StructType([*rows.schema.fields]).add("bucket", "integer")).parquet(path)

    def commit(self, spark: SparkSession, batch: Batch, whole: bool = False, keys: Sequence[str] = ()) -> None:
        """From now on the batch counts. One file appears at once, so readers see all of its tables or none."""
        line = [(batch.run, json.dumps(sorted({batch.key, *keys})), whole, batch.tables, batch.schemas)]
        spark.createDataFrame(line, LOG).coalesce(1).write.mode("overwrite").json(f"{self.root}/log/{batch.run:012d}")

    # --- reading -----------------------------------------------------------

    def read(self, spark: SparkSession, name: str, buckets: Sequence[int] | None = None, also: Batch | None = None) -> DataFrame | None:
        """All logged rows of a table with their `run`, and those of a batch that is still being written; None where there is none."""
        written = [(r.run, r.tables[name], r.schemas[name]) for r in self.log(spark) if name in r.tables]
        if also is not None and name in also.tables:
            written.append((also.run, also.tables[name], also.schemas[name]))
        if not written:
            return None
        fields: dict = {}
        for _, _, schema in written:
            fields |= {f.name: f for f in StructType.fromJson(json.loads(schema)).fields}
        schema = StructType(list(fields.values())).add("run", "long").add("attempt", "string").add("bucket", "integer")
        rows = spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[p for _, p, _ in written])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("attempt", "bucket")

    def newest(self, spark: SparkSession, name: str, key: str, apps: DataFrame | None = None, buckets: Sequence[int] | None = None, also: Batch | None = None) -> DataFrame:
        """The row of the latest run per key. Only the applications asked for are reduced, and only their buckets read."""
        rows = self.read(spark, name, buckets, also)
        if apps is not None:
            rows = rows.join(apps, "app_id", "left_semi")
        others = [c for c in rows.columns if c not in (key, "run")]
        return rows.groupBy(key).agg(F.max("run").alias("run"), F.max_by(F.struct(*others), "run").alias("r")).select(key, "run", "r.*")

    def rows_of(self, spark: SparkSession, name: str, latest: DataFrame, key: str, buckets: Sequence[int] | None = None, also: Batch | None = None) -> DataFrame:
        """The rows of a table that were written together with the newest version of what `latest` (key, run) lists."""
        return self.read(spark, name, buckets, also).join(latest.select(key, "run"), [key, "run"], "left_semi").drop("run")

    def touched(self, apps: DataFrame) -> list[int]:
        """The buckets of some applications: at most `buckets` numbers."""
        return sorted(r.bucket for r in apps.select(self.bucket().alias("bucket")).distinct().collect())

    def compact(self, spark: SparkSession, newest: dict[str, str], follow: dict[str, tuple[str, str]]) -> None:
        """Replace all batches by one that holds what counts now. `newest`: table to key; `follow`: table to (table it goes with, key)."""
        log = self.log(spark)
        batch = Batch(1 + max(r.run for r in log), f"compacted-{log[-1].run}", {}, {})
        kept = {name: self.newest(spark, name, key) for name, key in newest.items()}
        for name, rows in kept.items():
            self.write(batch, name, rows.drop("run"))
        for name, (with_table, key) in follow.items():
            if self.read(spark, name) is not None:
                self.write(batch, name, self.rows_of(spark, name, kept[with_table], key))
        self.commit(spark, batch, whole=True, keys=self.keys(spark))
