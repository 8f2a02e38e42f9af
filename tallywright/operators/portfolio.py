"""Applications: uploads, limits, scope, reviewer decisions, consent, deletion and the rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions.text import lookup
from tallywright.operators.decide import finding_order, rule_score, severity_counts, verdict_of
from tallywright.operators.ordered import top_k

PENDING = ("queued", "processing")


def effective_verdict(decision: Column, verdict: Column) -> Column:
    """A reviewer's decision replaces the engine's verdict."""
    return F.when(decision == "genuine", "pass").when(decision.isNotNull(), "fail").otherwise(verdict)


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Mark each upload with a reject_reason or null, and its request. Needs request_id, seq, filename, size, kind.

    Files past the first ten of a request are not taken, empty ones are passed over; a file that is too large or of no
    known type rejects its whole request (request_rejected), of which nothing is stored. Every row is kept and labelled.
    """
    over = top_k(uploads.select("request_id", "seq"), ["request_id"], [F.col("seq")], K.MAX_FILES_PER_REQUEST)
    taken = over.select("request_id", "seq", F.lit(True).alias("_taken"))
    base = F.regexp_extract(F.coalesce("filename", F.lit("document")), "[^/]*$", 0)
    marked = uploads.join(taken, ["request_id", "seq"], "left").select(
        *[c for c in uploads.columns if c != "filename"], F.substring(base, 1, K.NAME_CHARS).alias("filename"),
        F.when(F.col("_taken").isNull(), "too_many_files").when(F.col("size") > K.MAX_UPLOAD_BYTES, "too_large")
        .when(F.col("size") == 0, "empty").when(F.col("kind").isNull(), "unknown_type").alias("reject_reason"))
    fatal = marked.where(F.col("reject_reason").isin("too_large", "unknown_type")).select("request_id").distinct().withColumn("request_rejected", F.lit(True))
    return marked.join(fatal, "request_id", "left").withColumn("request_rejected", F.coalesce("request_rejected", F.lit(False)))


def open_for_public_upload(documents: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications that still take files through their public link."""
    n = documents.groupBy("app_id").agg(F.count("*").alias("n_docs"))
    d = applications.join(n, "app_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return d.where(F.col("n_docs") < K.MAX_DOCS_PER_PUBLIC_LINK)


def tenant_documents(documents: DataFrame, applications: DataFrame, org_id: int) -> DataFrame:
    mine = applications.where(F.col("org_id") == org_id)
    return documents.join(mine.select("app_id"), "app_id", "left_semi")


def newest_applications(applications: DataFrame, org_id: int, n: int = K.NEWEST_APPLICATIONS) -> DataFrame:
    """The newest applications of one tenant (a top-n report)."""
    return applications.where(F.col("org_id") == org_id).orderBy(F.desc("app_id")).limit(n)


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("app_id").agg(
        F.count("*").alias("n_docs"), F.bool_or(F.col("status").isin(*PENDING)).alias("pending"))


def document_rows(documents: DataFrame) -> DataFrame:
    """The reviewer's list of documents; risk, doc_type, source and created_at where the documents have them."""
    more = [c for c in ("risk", "doc_type", "source", "created_at") if c in documents.columns]
    eff = effective_verdict(F.col("decision"), F.col("verdict"))
    return documents.select(
        "doc_id", "app_id", "filename", "status", eff.alias("verdict"), F.col("verdict").alias("engine_verdict"),
        F.col("decision").isNotNull().alias("reviewed"), lookup(K.HEADLINES, eff).alias("headline"), *more)


def applicant_view(documents: DataFrame) -> DataFrame:
    """What an applicant may see: a state per file and nothing forensic."""
    eff = effective_verdict(F.col("decision"), F.col("verdict"))
    return documents.select("app_id", "doc_id", "filename", F.when(F.col("status").isin(*PENDING), "Checking").when(
        eff == "pass", "Received").otherwise("More information needed").alias("state"))


def finished(documents: DataFrame) -> DataFrame:
    """Documents that take part in the rollup, with the effective verdict."""
    return documents.where(F.col("status").isin("done", "error")).withColumn(
        "verdict", effective_verdict(F.col("decision"), F.col("verdict")))


def apply_reviews(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest valid decision per document; 'clear' removes it. reviews: doc_id, seq, decision, notes, by, at."""
    valid = reviews.where(F.col("decision").isin("genuine", "fraudulent", "clear"))
    last = valid.groupBy("doc_id").agg(F.max_by(F.struct(
        "decision", F.substring(F.coalesce("notes", F.lit("")), 1, K.NOTE_CHARS).alias("notes"), "by", "at"), "seq").alias("r"))
    d = documents.drop("decision").join(last, "doc_id", "left")
    keep = F.col("r.decision") != "clear"
    return d.select(*[c for c in documents.columns if c != "decision"], F.when(keep, F.col("r.decision")).alias("decision"),
                    F.when(keep, F.col("r.notes")).alias("review_notes"), F.when(keep, F.col("r.by")).alias("review_by"),
                    F.when(keep, F.col("r.at")).alias("review_at"))


def apply_consent(applications: DataFrame, events: DataFrame) -> DataFrame:
    """Latest consent event per application. events: app_id, seq, training, who, at."""
    last = events.groupBy("app_id").agg(F.max_by(F.struct("training", F.substring("who", 1, 40).alias("who"), "at"), "seq").alias("e"))
    base = applications.drop("consent_by", "consent_at")
    return base.join(last, "app_id", "left").select(
        *[c for c in base.columns if c != "training_consent"],
        F.coalesce("e.training", F.col("training_consent") if "training_consent" in base.columns else F.lit(False)).alias("training_consent"),
        F.col("e.who").alias("consent_by"), F.col("e.at").alias("consent_at"))


def delete_applications(applications: DataFrame, documents: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = deletions.select("app_id").distinct()
    return applications.join(gone, "app_id", "left_anti"), documents.join(gone, "app_id", "left_anti")


def trainable(documents: DataFrame, applications: DataFrame) -> DataFrame:
    """Reviewed documents with features whose applicant consented."""
    ok = applications.where("training_consent").select("app_id")
    d = documents.where(F.col("decision").isNotNull() & F.col("features").isNotNull())
    return d.join(ok, "app_id", "left_semi").withColumn("label", (F.col("decision") == "fraudulent").cast("int"))


def label_counts(documents: DataFrame, applications: DataFrame) -> DataFrame:
    """How many documents carry a decision, and how many of those may be trained on."""
    d = documents.where(F.col("decision").isNotNull()).join(applications.select("app_id", "training_consent"), "app_id", "left")
    return d.agg(F.count("*").alias("labelled_documents"),
                 F.count_if(F.col("training_consent") & F.col("has_features")).alias("consented_documents"))


def rollup(documents: DataFrame, cross: DataFrame) -> DataFrame:
    """Verdict and pending flag per application from finished documents and cross-document findings."""
    done = finished(documents).groupBy("app_id").agg(
        F.max(lookup(K.VERDICT_RANK, F.col("verdict"))).alias("doc_rank"), F.count("*").alias("n_done"))
    x = severity_counts(cross, ["app_id"]).withColumn("rule_score", rule_score())
    x = x.select("app_id", lookup(K.VERDICT_RANK, verdict_of(F.col("rule_score"))).alias("cross_rank"))
    d = document_counts(documents).join(done, "app_id", "left").join(x, "app_id", "left")
    worst = F.greatest("doc_rank", F.coalesce("cross_rank", F.lit(0)))
    return d.select(
        "app_id", "n_docs", "pending", F.coalesce("n_done", F.lit(0)).alias("n_done"),
        F.when(F.col("n_done") > 0, F.element_at(F.array(F.lit("pass"), F.lit("review"), F.lit("fail")), worst + 1)).alias("verdict"))


def _first_places(per_document: DataFrame, listed: str, name: str, documents: DataFrame, cross: DataFrame, cross_value: str) -> DataFrame:
    """Distinct values per application with the key of their first place: open documents first, then cross findings."""
    open_docs = finished(documents).where(F.col("verdict") != "pass").select("doc_id", "app_id")
    a = per_document.join(open_docs, "doc_id").select(
        "app_id", "doc_id", F.posexplode(listed).alias("pos", name)).select(
        "app_id", name, F.struct(F.lit(0).alias("stage"), F.lit(0).cast("bigint").alias("sub"), "doc_id", "pos").alias("at"))
    b = cross.where(F.col("severity").isin("high", "medium") & F.col(cross_value).isNotNull()).select(
        "app_id", F.col(cross_value).alias(name), F.struct(F.col("emit").alias("stage"), "sub", "doc_id", F.lit(0).alias("pos")).alias("at"))
    return a.unionByName(b).groupBy("app_id", name).agg(F.min("at").alias("at"))


def application_needs(doc_needs: DataFrame, documents: DataFrame, cross_described: DataFrame) -> DataFrame:
    """(app_id, need, at): what would settle an application. ``doc_needs``: doc_id, needs."""
    return _first_places(doc_needs, "needs", "need", documents, cross_described, "fix")


def application_requests(doc_requests: DataFrame, documents: DataFrame, cross_described: DataFrame) -> DataFrame:
    """(app_id, request, at): what the applicant is asked to send. ``doc_requests``: doc_id, asks."""
    return _first_places(doc_requests, "asks", "request", documents, cross_described, "applicant_request")


def finding_top(findings: DataFrame, k: int = 5) -> DataFrame:
    return top_k(findings, ["doc_id"], finding_order(), k)
