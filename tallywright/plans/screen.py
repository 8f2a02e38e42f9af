"""The whole batch job: printed documents or typed tables in, finding, evidence, verdict, income and application tables out.

Each stage writes its table and the next reads it back, so a lost executor repeats one stage at most and the
balance chain, which three later stages need, is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import bank_rules, cross, decide, fields, file_rules, income, portfolio, rows, stub_rules
from tallywright.operators.evidence import evidence
from tallywright.operators.findings import describe
from tallywright.session import staged


@dataclass(frozen=True)
class Inputs:
    documents: DataFrame      # doc_id, app_id, filename, sha256, status, decision
    stubs: DataFrame
    stub_lines: DataFrame
    statements: DataFrame
    bank_txns: DataFrame
    applications: DataFrame
    orgs: DataFrame
    file_findings: DataFrame | None = None


def typed_documents(x: Inputs) -> DataFrame:
    """(doc_id, doc_type) of every document; unknown where neither kind of fields was read from it."""
    kinds = x.stubs.select("doc_id", F.lit("paystub").alias("doc_type")).unionByName(x.statements.select("doc_id", F.lit("bank_statement").alias("doc_type")))
    return x.documents.select("doc_id").join(kinds, "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown")))


@dataclass(frozen=True)
class Printed:
    """What is read from files: positioned text, page facts, and the files' own facts where there are any."""
    spans: DataFrame          # doc_id, page, span_no, text, x0 .. y1, font, size
    pages: DataFrame          # doc_id, page, width, height, ocr, image_cover, visible_text_spans
    documents: DataFrame      # doc_id, app_id, filename, sha256, status, decision, applicant, created, ocr_used, kind
    applications: DataFrame
    orgs: DataFrame
    files: DataFrame | None = None      # doc_id, kind and metadata: with it the file's own rules run
    patches: DataFrame | None = None
    annotations: DataFrame | None = None
    ocr_spans: DataFrame | None = None  # what OCR read on pages that are pictures


def spans_to_read(x: Printed) -> DataFrame:
    """Pages that are pictures are read from their OCR words where there are any, the others from their own text."""
    own = rows.clean_spans(x.spans)
    if x.ocr_spans is None:
        return own
    pictures = x.pages.where(F.coalesce("ocr", F.lit(False))).select("doc_id", "page")
    return own.join(pictures, ["doc_id", "page"], "left_anti").unionByName(rows.clean_spans(x.ocr_spans).join(pictures, ["doc_id", "page"], "left_semi").select(*own.columns))


def read_documents(x: Printed, today: str) -> tuple[Inputs, DataFrame]:
    """Fields of all documents, and where each value stands. Spans and rows are stages: several steps read both."""
    spans = staged(spans_to_read(x), "spans-to-read")
    text = staged(rows.build_rows(spans), "text-rows")
    types = staged(fields.classify(text).select("doc_id", "doc_type"), "document-types")
    of = lambda df, kind: df.join(types.where(F.col("doc_type") == kind).select("doc_id"), "doc_id", "left_semi")
    stub = fields.extract_stub_tables(of(text, "paystub"), of(spans, "paystub"), x.pages)
    bank = fields.extract_statements(of(text, "bank_statement"), today)
    known = x.documents.select("doc_id", "app_id", "filename", "applicant", "created", "ocr_used")
    found = file_rules.unreadable_findings(rows.unreadable_documents(x.documents, spans))
    if x.files is not None:
        live = x.pages.where(~F.coalesce("ocr", F.lit(False))).select("doc_id", "page")
        own = staged(rows.clean_spans(x.spans).join(live, ["doc_id", "page"], "left_semi"), "live-spans")
        stacked = staged(file_rules.stacked_pages(own), "stacked-pages")  # the pair table, read by both rules about covered text
        money, ocr = stub["money"].unionByName(bank["money"]), x.documents.where("ocr_used").select("doc_id")
        more = [file_rules.metadata_findings(x.files), file_rules.scan_findings(x.files, x.pages), file_rules.stacked_page_findings(stacked), file_rules.font_findings(money),
                file_rules.alignment_findings(stub["lines"], ocr), file_rules.size_findings(stub["lines"], ocr)]
        if x.patches is not None:
            more.append(file_rules.patch_findings(x.patches, own, x.pages, stacked))
        if x.annotations is not None:
            more.append(file_rules.annotation_findings(x.annotations))
        for f in more:
            found = found.unionByName(f)
    documents = x.documents.select("doc_id", "app_id", "filename", "sha256", "status", "decision")
    inputs = Inputs(documents, stub["stubs"].join(known, "doc_id"), stub["lines"], bank["statements"].join(known, "doc_id"), bank["txns"], x.applications, x.orgs, found)
    return inputs, stub["boxes"].unionByName(bank["boxes"])


def screen_printed(spark: SparkSession, x: Printed, out: str, today: str) -> dict[str, DataFrame]:
    """From positioned text to verdicts: read the documents, screen them, and add the evidence of every finding."""
    inputs, boxes = read_documents(x, today)
    done = screen_portfolio(spark, inputs, out, today)
    evidence(done["findings"], boxes).write.mode("overwrite").parquet(f"{out}/evidence")
    done["evidence"] = spark.read.parquet(f"{out}/evidence")
    return done


def screen_portfolio(spark: SparkSession, x: Inputs, out: str, today: str) -> dict[str, DataFrame]:
    done: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        done[name] = spark.read.parquet(f"{out}/{name}")
        return done[name]

    chain = stage("bank_lines", bank_rules.balance_chain(x.bank_txns, x.statements))
    facts = stage("bank_facts", bank_rules.statement_facts(chain))
    types = typed_documents(x)
    found = (stub_rules.all_stub_findings(x.stubs, x.stub_lines, today).unionByName(bank_rules.bank_findings(x.statements, x.bank_txns, facts))
             .unionByName(file_rules.type_findings(types)))
    if x.file_findings is not None:
        found = found.unionByName(x.file_findings)
    findings = stage("findings", decide.gated(found))
    scores = stage("scores", decide.score_documents(x.documents, findings))

    documents = x.documents.drop("verdict").join(scores.select("doc_id", "verdict", "risk"), "doc_id")
    finished = portfolio.finished(documents)
    fields = x.stubs.select("doc_id", "employer", "pay_date", "net", "gross", "gross_ytd", "frequency").withColumn("doc_type", F.lit("paystub"))
    typed = fields.unionByName(x.statements.select("doc_id", F.lit("bank_statement").alias("doc_type")), allowMissingColumns=True)
    reports = stage("reports", finished.join(typed, "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown"))))
    banks = x.statements.drop("verdict").join(reports.select("doc_id", "verdict"), "doc_id")
    between = stage("cross_findings", cross.cross_findings(reports, banks, chain, facts))

    stage("income", income.income(reports, x.applications, x.orgs))
    stage("applications", portfolio.rollup(documents, between))
    described, described_between = describe(findings), describe(between)
    stage("needs", portfolio.application_needs(decide.needs_to_pass(described), documents, described_between))
    stage("requests", portfolio.application_requests(decide.applicant_requests(described, scores), documents, described_between))
    return done
