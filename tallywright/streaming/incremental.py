"""New uploads as a stream: screen what each micro-batch brings, then refresh only the applications it touched.

A document's own findings depend on its own rows. What compares documents (copies of a file, consecutive stubs, deposits on a statement)
is worked out anew for the applications of the batch from everything stored about them, so it does not matter in which order, or in how
many batches, stubs, statements and copies arrive. Typed rows lie in folders by arrival, and a batch reads those of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywright.operators import bank_rules, cross, decide, portfolio
from tallywright.operators.file_rules import type_findings
from tallywright.operators.stub_rules import all_stub_findings
from tallywright.session import staged, together
from tallywright.streaming.store import Batch, Store

#: How the tables of a store hang together: one newest row per key, or rows that go with the newest row of another table.
NEWEST = {"reports": "doc_id", "applications": "app_id"}
FOLLOW = {"findings": ("reports", "doc_id"), "bank_lines": ("reports", "doc_id"), "bank_facts": ("reports", "doc_id"), "cross_findings": ("applications", "app_id")}
FIELDS = ("employer", "pay_date", "net", "gross", "gross_ytd", "frequency")


@dataclass(frozen=True)
class Arrivals:
    """Typed tables in folders by `arrived`. documents: doc_id, app_id, filename, sha256, decision; file_findings may be missing."""
    documents: DataFrame
    stubs: DataFrame
    stub_lines: DataFrame
    statements: DataFrame
    bank_txns: DataFrame
    file_findings: DataFrame | None = None

    def of(self, queue: DataFrame) -> Arrivals:
        """The rows of the queued documents: only the folders of their arrivals are opened (a batch names a few)."""
        folders = [r.arrived for r in queue.select("arrived").distinct().collect()]
        mine = queue.select("doc_id").distinct()
        cut = lambda df: None if df is None else df.where(F.col("arrived").isin(folders)).drop("arrived").join(mine, "doc_id", "left_semi")
        return Arrivals(*[cut(getattr(self, f)) for f in self.__dataclass_fields__])


def screen_documents(store: Store, batch: Batch, x: Arrivals, today: str) -> DataFrame:
    """Findings, scores and reports of the batch's own documents, written to the store; gives the reports."""
    owner = x.documents.select("doc_id", "app_id")
    owned = lambda df: df.drop("app_id").join(owner, "doc_id")

    def read_statements() -> DataFrame:
        lines = store.write(batch, "bank_lines", owned(bank_rules.balance_chain(x.bank_txns, x.statements)))
        return store.write(batch, "bank_facts", owned(bank_rules.statement_facts(lines)))

    facts, of_stubs = together(x.stubs.sparkSession, read_statements, lambda: staged(all_stub_findings(x.stubs, x.stub_lines, today), "stub-findings"))
    typed = (x.stubs.select("doc_id", F.lit("paystub").alias("doc_type"), *FIELDS)
             .unionByName(x.statements.select("doc_id", F.lit("bank_statement").alias("doc_type")), allowMissingColumns=True))
    documents = x.documents.join(typed, "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown")))
    found = of_stubs.unionByName(bank_rules.bank_findings(x.statements, x.bank_txns, facts.drop("app_id", "bucket")))
    found = found.unionByName(type_findings(documents.select("doc_id", "doc_type")))
    if x.file_findings is not None:
        found = found.unionByName(x.file_findings)
    findings = store.write(batch, "findings", owned(decide.gated(found)))
    scores = decide.score_documents(documents, findings)
    return store.write(batch, "reports", documents.join(scores.select("doc_id", "verdict", "risk"), "doc_id").withColumn("status", F.lit("done")))


def refresh_applications(spark: SparkSession, store: Store, batch: Batch, apps: DataFrame) -> None:
    """Cross-document findings and rollup of some applications, from all that is stored about them."""
    buckets = store.touched(apps)
    latest = staged(store.newest(spark, "reports", "doc_id", apps, buckets, batch), "latest-reports")
    reports = portfolio.finished(latest.drop("run"))
    stored = lambda name: store.rows_of(spark, name, latest, "doc_id", buckets, batch)
    banks = reports.where(F.col("doc_type") == "bank_statement").select("app_id", "doc_id", "filename", "verdict")
    chain, facts = stored("bank_lines").drop("app_id"), stored("bank_facts").drop("app_id")
    between = store.write(batch, "cross_findings", cross.cross_findings(reports, banks, chain, facts))
    store.write(batch, "applications", portfolio.rollup(latest.drop("run"), between.drop("bucket")))


def process_batch(spark: SparkSession, queue: DataFrame, key: str, store: Store, arrivals: Arrivals, today: str, before_commit: Callable[[str], None] | None = None) -> None:
    """Queue rows (doc_id, arrived) to stored reports, findings and refreshed applications; nothing where the key is logged already."""
    batch = store.open(spark, key)
    if batch is None:
        return
    reports = screen_documents(store, batch, arrivals.of(queue), today)
    refresh_applications(spark, store, batch, reports.select("app_id").distinct())
    if before_commit is not None:
        before_commit(key)
    store.commit(spark, batch)


def start_screening(queue: DataFrame, store: Store, arrivals: Arrivals, today: str, checkpoint: str, before_commit: Callable[[str], None] | None = None, **trigger) -> StreamingQuery:
    """Run :func:`process_batch` on every micro-batch of the queue stream. A batch that Spark repeats has the same key."""
    spark = queue.sparkSession

    def run(rows: DataFrame, batch_id: int) -> None:
        process_batch(spark, rows, f"stream-{batch_id}", store, arrivals, today, before_commit)

    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reanalyze(spark: SparkSession, queue: DataFrame, key: str, store: Store, arrivals: Arrivals, today: str) -> None:
    """Re-run listed documents as a batch of their own; its reports replace the older ones, and their applications are refreshed."""
    process_batch(spark, queue, key, store, arrivals, today)


def documents_of(spark: SparkSession, store: Store) -> DataFrame:
    return store.newest(spark, "reports", "doc_id")


def findings_of(spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame]:
    """(findings of documents, findings between documents) as they stand now."""
    return tuple(store.rows_of(spark, name, store.newest(spark, table, key), key) for name, (table, key) in (("findings", FOLLOW["findings"]), ("cross_findings", FOLLOW["cross_findings"])))


def applications_of(spark: SparkSession, store: Store) -> DataFrame:
    return store.newest(spark, "applications", "app_id").drop("run")


def compact(spark: SparkSession, store: Store) -> None:
    store.compact(spark, NEWEST, FOLLOW)
