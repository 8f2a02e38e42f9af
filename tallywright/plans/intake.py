"""Queries over sources, sinks and the upload stream."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.operators.decide import score_documents
from tallywright.plans import applications as AP
from tallywright.plans import fixtures as X
from tallywright.plans import statements as BK
from tallywright.plans import stubs as SB
from tallywright.plans.registry import query
from tallywright.session import ensure_checkpoint_dir, together
from tallywright.sources import annotations as AN
from tallywright.sources import files as FS
from tallywright.sources import sinks as SK
from tallywright.streaming import incremental as ST


def scratch(spark, name: str) -> str:
    """A folder of this run in the store every executor reaches."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Each text becomes a file: a PDF shell around it, or one of the image types by its first bytes.
_HEAD = "CASE doc_id % 6 WHEN 0 THEN '%PDF-1.4 /Linearized /Producer (Sejda \\(web\\) 3.2) /CreationDate (D:19980305101500)' WHEN 1 THEN 'RIFF0000WEBP' WHEN 2 THEN 'II*' ELSE '%PDF-1.7 /Producer (PDFKit)' END"


def uploads(spark, d):
    doc = X.table(spark, d, "documents")
    k = F.col("doc_id") % 6
    head = (F.when(k == 0, r"%PDF-1.4 /Linearized /Producer (Sejda \(web\) 3.2) /CreationDate (D:19980305101500)").when(k == 1, "RIFF0000WEBP")
            .when(k == 2, "II*").otherwise("%PDF-1.7 /Producer (PDFKit)"))
    body = F.concat(head, F.lit("\n"), F.col("text"), F.repeat(F.lit("\n%%EOF"), (F.col("doc_id") % 3).cast("int")))
    content = body.cast("binary")
    return doc.select("doc_id", F.concat(F.lit("file:/in/a/"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "-g.tif").otherwise("-f.tif")).alias("path"),
                      F.length(content).cast("bigint").alias("length"), content.alias("content"))


_BODY = f"SELECT doc_id, {_HEAD} || chr(10) || text || repeat(chr(10) || '%%EOF', cast(doc_id % 3 AS int)) AS body, text FROM documents"


@query("s1_uploads", f"SELECT doc_id, doc_id || CASE WHEN doc_id % 2 = 0 THEN '-g.tif' ELSE '-f.tif' END AS filename, cast(strlen(body) AS bigint) AS size, sha256(body) AS sha256 FROM ({_BODY}) b")
def read_uploads(spark, d):
    u = uploads(spark, d)
    return FS.describe_uploads(u).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "filename", "size", "sha256")


@query("s2_sniff", "SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'webp' WHEN 2 THEN NULL ELSE 'pdf' END AS kind FROM documents")
def sniff(spark, d):
    return uploads(spark, d).select("doc_id", FS.sniff(F.col("content")).alias("kind"))


@query("s3_s4_byte_facts", f"""
SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 2) THEN 1 ELSE cast(len(string_split(body, '%%EOF')) - 1 AS bigint) END AS n_eof, doc_id % 6 = 0 AS linearized,
  CASE WHEN doc_id % 6 = 0 THEN 'Sejda \\(web\\) 3.2' WHEN doc_id % 6 > 2 THEN 'PDFKit' END AS producer, CASE WHEN doc_id % 6 = 0 THEN 'D:19980305101500' END AS created FROM ({_BODY}) b""")
def byte_facts(spark, d):
    u = uploads(spark, d).withColumn("kind", FS.sniff(F.col("content")))
    return FS.byte_facts(u).select("doc_id", "n_eof", "linearized", "producer", "created")


@query("s5_ocr_words", "SELECT l_orderkey AS doc_id, cast(l_linenumber AS bigint) AS page, count(*) AS n, round(sum((l_partkey + l_quantity) * 0.36::double), 6) AS right_edges FROM lineitem WHERE l_quantity * 2 >= 30 GROUP BY 1, 2")
def ocr_words(spark, d):
    w = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("span_no"),
                                             F.col("l_partkey").alias("left"), F.lit(5).alias("top"), F.col("l_quantity").alias("width"), F.lit(9).alias("height"),
                                             (F.col("l_quantity") * 2).alias("conf"), F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("text"))
    s = FS.ocr_spans(w, 0.36)
    return s.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 6).alias("right_edges"))


@query("s6_positioned_text", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_quantity <= 12 GROUP BY 1")
def positioned_text(spark, d):
    from tallywright.operators.rows import clean_spans
    s = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("page"), F.concat(F.lit(" "), "l_returnflag").alias("text"), F.col("l_tax").alias("size"))
    return clean_spans(s, K.MAX_PAGES).where("NOT past_limit").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s7_pruned_scan", "SELECT o_orderkey AS doc_id, o_custkey AS app_id FROM orders WHERE o_orderstatus = 'F'")
def pruned_scan(spark, d):
    return X.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("app_id"))


@query("s8_manifest_boxes", "SELECT concat('img', s_suppkey) AS image, s_suppkey * 1.0::double AS x0, 5.0::double AS y0, s_suppkey + 20.0::double AS x1, 35.0::double AS y1 FROM supplier WHERE s_nationkey % 2 = 1 AND s_suppkey % 3 > 0")
def manifest(spark, d):
    s = X.table(spark, d, "supplier")
    note = F.when(F.col("s_suppkey") % 3 == 0, "yes").otherwise("no")
    ann = F.concat(F.lit("{'filename': None, 'regions': [{'shape_attributes': {'name': 'rect', 'x': "), "s_suppkey", F.lit(", 'y': 5, 'width': 20, 'height': 30}, 'region_attributes': {'Original area': '"),
                   note, F.lit("'}}]}"))
    m = s.select(F.concat(F.lit("img"), "s_suppkey").alias("image"), (F.col("s_nationkey") % 2).cast("string").alias("forged"), ann.alias("forgery annotations"))
    return AN.manifest_boxes(m)


@query("s10_labelled_files", "SELECT doc_id, doc_id % 2 = 1 AS forged FROM documents")
def labelled(spark, d):
    return AN.labelled_files(uploads(spark, d)).select("doc_id", "forged")


@query("s11_report_sink", SB.sql("SELECT doc_id, verdict, cast(c + h + m + l AS bigint) AS findings FROM verdicts", SB.VERDICTS))
def report_sink(spark, d):
    """Reports written as a partitioned table and read back."""
    s = X.stubs(spark, d).drop("verdict")
    f = SB.findings(spark, d)
    path = scratch(spark, "reports")
    SK.write_reports(SK.build_reports(s.select("doc_id", "app_id", "filename"), score_documents(s, f), f, X.TODAY), path)
    return SK.report_view(spark.read.parquet(path)).select("doc_id", "verdict", "findings")


@query("s12_failed_documents", SB.sql("SELECT doc_id, 'unreadable' AS verdict, 'no value: ' || concat_ws(', ', CASE WHEN gross_c IS NULL THEN 'gross' END, CASE WHEN net_c IS NULL THEN 'net' END) AS error FROM d_wide WHERE gross_c IS NULL OR net_c IS NULL"))
def failed(spark, d):
    return SK.split_failed(X.stubs(spark, d), ["gross", "net"])[1].select("doc_id", "verdict", "error")


_LOGGED = {"doc_id": "bigint", "kind": "string", "gross": "decimal(18,2)", "pay_date": "date"}


@query("s12_upload_records", X.with_views("""
SELECT CASE WHEN k % 50 <> 0 THEN doc_id END AS doc_id, CASE k % 50 WHEN 0 THEN 'broken record' WHEN 1 THEN 'gross is no decimal(18,2): ' || (gross_c // 100) || ' dollars' WHEN 2 THEN 'no value: pay_date'
       WHEN 3 THEN 'unknown kind: exe' WHEN 4 THEN 'gross is no decimal(18,2): twelve; no value: pay_date' ELSE '' END AS error,
       CASE WHEN k % 50 >= 5 OR k % 50 < 0 THEN 'typed' ELSE 'unreadable' END AS verdict FROM d_wide WHERE gross_c IS NOT NULL""", "d_wide"))
def upload_records(spark, d):
    """Upload records written as JSON lines, some broken in four ways, and read back: each is typed or reported, none is lost."""
    w = X.view(spark, d, "d_wide").where("gross_c IS NOT NULL")
    k = F.col("k") % 50
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.when(k == 3, "exe").otherwise("pdf").alias("kind"),
                                F.when(k == 1, F.concat((F.floor(F.col("gross_c") / 100)).cast("string"), F.lit(" dollars"))).when(k == 4, "twelve").otherwise(X.money("gross_c").cast("string")).alias("gross"),
                                F.when(~k.isin(2, 4), F.col("pay_date").cast("string")).alias("pay_date")))
    path = scratch(spark, "upload-log")
    w.select(F.when(k == 0, F.substring(record, 2, 1 << 20)).otherwise(record).alias("value")).write.text(path)
    typed, failed = SK.typed_or_failed(SK.read_uploads_log(spark, path, _LOGGED), _LOGGED, ["doc_id", "pay_date"], ["pdf", "jpeg"])
    return failed.select("doc_id", "error", "verdict").unionByName(typed.select("doc_id", F.lit("").alias("error"), F.lit("typed").alias("verdict")))


@query("s9_xml_zones", "SELECT l_quantity::double AS x0, l_linenumber * 10.5::double AS y0, l_quantity + 1 + l_discount * 100 AS x1, l_linenumber * 10.5::double + 8 AS y1, count(*) AS n FROM lineitem GROUP BY ALL")
def xml_zones(spark, d):
    """Boxes of a table written as XML zones into the shared folder and read by their row tag."""
    li = X.table(spark, d, "lineitem")
    path = scratch(spark, "zones")
    li.select(F.col("l_quantity").cast("double").alias("_x"), (F.col("l_linenumber") * 10.5).alias("_y"), (1 + F.col("l_discount") * 100).cast("double").alias("_width"), F.lit(8.0).alias("_height")) \
        .write.format("xml").option("rootTag", "zones").option("rowTag", "zone").save(path)
    return AN.read_zones(spark, path).groupBy("x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))


@query("s13_audit_trail", "SELECT action, count(*) AS n FROM (SELECT 'document.view' AS action FROM events UNION ALL SELECT 'document.review' FROM events WHERE event_type = 'error') x GROUP BY action")
def audit(spark, d):
    e = X.table(spark, d, "events").select(F.lit(1).alias("org_id"), "user_id", "event_id", "event_type", F.col("ts").alias("at"))
    path = scratch(spark, "audit")
    SK.append_audit(SK.audit_rows(e, "document.view", "event_id"), path)
    SK.append_audit(SK.audit_rows(e.where(F.col("event_type") == "error"), "document.review", "event_id", F.col("event_type")), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


@query("s14_schema_evolution", "SELECT c_custkey AS app_id, CASE WHEN c_custkey % 2 = 0 THEN false ELSE c_custkey % 3 = 0 END AS training_consent FROM customer")
def evolution(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("app_id"))
    path = scratch(spark, "applications")
    c.where(F.col("app_id") % 2 == 0).write.parquet(path + "/v=1")
    c.where(F.col("app_id") % 2 == 1).withColumn("training_consent", F.col("app_id") % 3 == 0).write.parquet(path + "/v=2")
    return SK.read_evolving(spark, path, {"training_consent": False}).select("app_id", "training_consent")


@query("p15_report_view", "SELECT o_orderkey AS doc_id FROM orders")
def report_view(spark, d):
    r = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(F.lit(1.0)).alias("features"))
    return SK.report_view(r)


@query("o7_prefix_rows", X.with_views("SELECT doc_id, least(6 + (begin_c IS NOT NULL)::int + (end_c IS NOT NULL)::int - 3 + 2 * n, 14) AS n FROM d_statements JOIN (SELECT doc_id, count(*) AS n FROM d_txn_pairs GROUP BY 1) t USING (doc_id)", "d_statements", "d_txn_pairs"))
def prefix_rows(spark, d):
    from tallywright.operators.ordered import top_k
    from tallywright.plans.extraction import bank_rows
    head = top_k(bank_rows(spark, d).select("doc_id", "page", "at"), ["doc_id"], [F.col("page"), F.col("at")], K.HOLDER_ROWS)
    return head.groupBy("doc_id").agg(F.count("*").alias("n"))


# --- the stream ------------------------------------------------------------

# What the batch job makes of the same documents: own verdicts for stubs and statements, and everything between them on top of these.
_own = lambda sql, prefix: re.sub(r"\b(scored|scores|verdicts)\b", prefix + r"_\1", sql)
STREAMED = ",".join([
    SB.RULES, _own(BK.VERDICT.format(docs="d_wide", findings="stub_findings"), "stub"), BK.FINDINGS, _own(BK.VERDICT.format(docs="d_statements", findings="bank_findings"), "bank"), """
e_wide AS (SELECT w.* REPLACE (v.verdict AS verdict, NULL::varchar AS decision, 'done' AS status) FROM d_wide w JOIN stub_verdicts v USING (doc_id)),
e_statements AS (SELECT s.* REPLACE (v.verdict AS verdict) FROM d_statements s JOIN bank_verdicts v USING (doc_id))""",
    AP.CROSS.removeprefix(BK.FACTS + ",").replace("FROM d_wide", "FROM e_wide").replace("FROM d_statements s JOIN facts", "FROM e_statements s JOIN facts"), """
copies AS (SELECT app_id, doc_id, lag(doc_id) OVER (PARTITION BY app_id, k % 16 ORDER BY doc_id) AS before FROM e_wide),
between_f AS (SELECT app_id, doc_id, code, severity FROM cross_findings UNION ALL SELECT app_id, doc_id, 'X_DUP', 'low' FROM copies WHERE before IS NOT NULL),
e_docs AS (SELECT app_id, doc_id, verdict FROM e_wide UNION ALL SELECT app_id, doc_id, verdict FROM e_statements),
xs AS (SELECT app_id, count(*) FILTER (severity='high') AS h, count(*) FILTER (severity='medium') AS m, count(*) FILTER (severity='low') AS l FROM between_f GROUP BY app_id),
xr AS (SELECT app_id, CASE WHEN h >= 2 OR 1 - pow(1-0.55::double, h) * pow(0.75::double, m) * pow(1-0.07::double, l) >= 0.85 THEN 2 WHEN h > 0 OR m >= 2 THEN 1 ELSE 0 END AS r FROM xs),
dr AS (SELECT app_id, max(CASE verdict WHEN 'fail' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) AS r, count(*) AS n_docs FROM e_docs GROUP BY app_id)"""])


def streamed(body: str) -> str:
    return X.with_views("WITH " + STREAMED + "\n" + body, "o_txns", "o_lines", "d_statements", "d_apps", "d_orgs", "d_wide")


def arrivals(spark, d) -> ST.Arrivals:
    """All documents, arriving in four parts: the stubs, statements and copies of one application come in different ones."""
    path = scratch(spark, "arrivals")
    sha = F.when(F.col("doc_id") < X.BANK_BASE, F.concat("app_id", F.lit("-"), F.col("doc_id") % 16)).otherwise(F.col("doc_id").cast("string"))
    names = ["doc_id", "app_id", "filename"]
    documents = X.stubs(spark, d).select(*names).unionByName(X.statements(spark, d).select(*names))
    documents = documents.withColumn("sha256", F.sha2(sha, 256)).withColumn("decision", F.lit(None).cast("string"))
    tables = {"documents": documents, "stubs": X.stubs(spark, d), "stub_lines": X.stub_lines(spark, d), "statements": X.statements(spark, d), "bank_txns": X.txns(spark, d)}

    def write(name: str) -> None:
        # by document and not by arrival: a task of a whole arrival would hold a quarter of the table
        tables[name].withColumn("arrived", F.col("doc_id") % 4).repartition("doc_id").write.partitionBy("arrived").parquet(f"{path}/{name}")

    together(spark, *[lambda name=name: write(name) for name in tables])
    return ST.Arrivals(*[spark.read.parquet(f"{path}/{name}") for name in tables])


def run_stream(spark, d, failing: str | None = "stream-1"):
    """The store after a stream of four micro-batches, one of which fails once before its commit and is repeated."""
    store, x, offsets, files = ST.Store(scratch(spark, "screening"), 8), arrivals(spark, d), scratch(spark, "offsets"), scratch(spark, "queue")
    queued = x.documents.select("doc_id", "arrived")
    queued.repartition(4, "arrived").sortWithinPartitions("arrived").withColumn("part", F.col("arrived")).write.partitionBy("part").parquet(files)
    queue = spark.readStream.schema(queued.schema).option("maxFilesPerTrigger", 1).parquet(f"{files}/*").select("doc_id", "arrived")
    failed = []

    def fail_once(key: str) -> None:
        if key == failing and not failed:
            failed.append(key)
            raise RuntimeError("lost before the commit")

    screen = lambda: ST.start_screening(queue, store, x, X.TODAY, offsets, fail_once).awaitTermination()
    try:
        screen()
    except StreamingQueryException:
        if not failed:
            raise
        screen()  # only the loss that was asked for is repeated, and only once: any other failure is the caller's
    return store, x


@query("st1_incremental_screening", streamed("SELECT doc_id, verdict FROM e_docs"))
def incremental(spark, d):
    store, _ = run_stream(spark, d)
    return ST.documents_of(spark, store).select("doc_id", "verdict")


@query("st1_stream_findings", streamed("SELECT doc_id, code, severity, emit, 'document' AS about FROM stub_findings UNION ALL SELECT doc_id, code, severity, emit, 'document' FROM bank_findings UNION ALL SELECT doc_id, code, severity, CASE WHEN code = 'X_DUP' THEN 200 WHEN code LIKE 'X_DEPOSIT%' THEN 202 ELSE 201 END, 'application' FROM between_f"))
def stream_findings(spark, d):
    store, _ = run_stream(spark, d)
    own, between = ST.findings_of(spark, store)
    of = lambda df, about: df.select("doc_id", "code", "severity", "emit", F.lit(about).alias("about"))
    return of(own, "document").unionByName(of(between, "application"))


@query("st2_refreshed_applications", streamed("SELECT app_id, n_docs, false AS pending, n_docs AS n_done, list_extract(['pass', 'review', 'fail'], cast(greatest(dr.r, coalesce(xr.r, 0)) + 1 AS int)) AS verdict FROM dr LEFT JOIN xr USING (app_id)"))
def refreshed(spark, d):
    store, _ = run_stream(spark, d)
    return ST.applications_of(spark, store).select("app_id", "n_docs", "pending", "n_done", "verdict")


@query("st3_reanalyze", SB.sql("SELECT doc_id, verdict FROM verdicts WHERE doc_id IN (SELECT doc_id FROM d_wide WHERE status = 'error')", SB.VERDICTS))
def reanalyze(spark, d):
    store, x = ST.Store(scratch(spark, "again"), 8), arrivals(spark, d)
    wanted = X.stubs(spark, d).where(F.col("status") == "error").select("doc_id")
    ST.reanalyze(spark, x.documents.select("doc_id", "arrived").join(wanted, "doc_id", "left_semi"), "again-0", store, x, X.TODAY)
    return ST.documents_of(spark, store).select("doc_id", "verdict")
