"""Queries over bank statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import bank_rules as B
from tallywright.operators.decide import score_documents
from tallywright.plans import fixtures as X
from tallywright.plans.registry import query

# The chain as plain SQL: previous printed balance, then the kind of each line.
CHAIN = """
chain0 AS (
  SELECT t.*, s.begin_c, coalesce(lag(balance_c) OVER (PARTITION BY t.doc_id ORDER BY txn_no), NULL) AS lagged,
         row_number() OVER (PARTITION BY t.doc_id ORDER BY txn_no) AS rn
  FROM o_txns t JOIN d_statements s ON s.doc_id = t.doc_id),
chain1 AS (SELECT *, CASE WHEN rn = 1 THEN begin_c ELSE lagged END AS prev_c FROM chain0),
chain AS (
  SELECT *, CASE WHEN abs(prev_c + amount_c - balance_c) <= 2 THEN 'deposit'
                 WHEN abs(prev_c - amount_c - balance_c) <= 2 THEN 'withdrawal'
                 WHEN regexp_matches(lower(descr), 'deposit|payroll|credit|direct dep|refund|transfer from') THEN 'deposit'
                 ELSE 'withdrawal' END AS kind,
         prev_c IS NOT NULL AND abs(prev_c + amount_c - balance_c) > 2 AND abs(prev_c - amount_c - balance_c) > 2 AS breaks
  FROM chain1)
"""
FACTS = CHAIN + """,
facts AS (
  SELECT doc_id, count(*) AS n_txns, sum(CASE WHEN kind = 'deposit' THEN amount_c ELSE 0 END) AS dep,
         sum(CASE WHEN kind <> 'deposit' THEN amount_c ELSE 0 END) AS wd, count(*) FILTER (kind = 'deposit') AS n_dep,
         min(dt) AS first_date, max(dt) AS last_date, arg_max(balance_c, txn_no) AS last_c,
         count(*) FILTER (breaks) AS n_breaks, min(txn_no) FILTER (breaks) AS first_break
  FROM chain GROUP BY doc_id)
"""
FINDINGS = FACTS + """,
bank_f AS (
  SELECT s.*, f.* EXCLUDE (doc_id), begin_c + deposits_c - withdrawals_c AS want FROM d_statements s LEFT JOIN facts f ON f.doc_id = s.doc_id),
bank_findings AS (
  SELECT doc_id, 'B_RUNNING' AS code, CASE WHEN ocr_used THEN 'medium' ELSE 'critical' END AS severity, 101 AS emit, first_break AS sub FROM bank_f WHERE first_break IS NOT NULL
  UNION ALL SELECT doc_id, 'B_ENDING', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 102, 0 FROM bank_f WHERE n_txns > 0 AND n_breaks = 0 AND abs(last_c - end_c) > 2
  UNION ALL SELECT doc_id, 'B_SUMMARY', CASE WHEN ocr_used THEN 'medium' ELSE 'critical' END, 103, 0 FROM bank_f WHERE abs(want - end_c) > 2
  UNION ALL SELECT doc_id, 'B_DEPOSITS', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 104, 0 FROM bank_f WHERE n_txns > 0 AND n_breaks = 0 AND abs(dep - deposits_c) > 2
  UNION ALL SELECT doc_id, 'C_NAME', 'high', 105, 0 FROM bank_f WHERE holder <> applicant)
"""


def sql(body: str, parts: str = CHAIN) -> str:
    return X.with_views("WITH " + parts + "\n" + body, "o_txns", "d_statements")


def chain_of(spark, d):
    return B.balance_chain(X.txns(spark, d), X.statements(spark, d))


@query("w1_running_balance", sql("SELECT doc_id, txn_no, prev_c/100.0 AS prev_balance, amount_c/100.0 AS amount, balance_c/100.0 AS balance, kind, breaks FROM chain"))
def running_balance(spark, d):
    return chain_of(spark, d).select("doc_id", "txn_no", "prev_balance", "amount", "balance", "kind", "breaks")


@query("r41_first_break", sql("SELECT doc_id, txn_no, balance_c/100.0 AS balance, prev_c/100.0 AS prev_balance FROM chain WHERE breaks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY txn_no) = 1"))
def first_break(spark, d):
    f = B.statement_facts(chain_of(spark, d)).where(F.col("first_break").isNotNull())
    return f.select("doc_id", "first_break.txn_no", "first_break.balance", "first_break.prev_balance")


@query("r42_transaction_kind", sql("SELECT kind, count(*) AS n, sum(amount_c)/100.0 AS total FROM chain GROUP BY kind"))
def transaction_kind(spark, d):
    return chain_of(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("a2_statement_totals", sql("SELECT doc_id, n_txns, dep/100.0 AS deposits, wd/100.0 AS withdrawals, last_c/100.0 AS last_balance FROM facts", FACTS))
def statement_totals(spark, d):
    return B.statement_facts(chain_of(spark, d)).select("doc_id", "n_txns", "deposits", "withdrawals", "last_balance")


@query("a3_statement_coverage", sql("SELECT doc_id, cast(first_date AS varchar) AS first_date, cast(last_date AS varchar) AS last_date FROM facts", FACTS))
def statement_coverage(spark, d):
    return X.txns(spark, d).groupBy("doc_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("r40_r46_bank_findings", sql("SELECT doc_id, code, severity, emit, sub FROM bank_findings", FINDINGS))
def bank_findings(spark, d):
    return B.bank_findings(X.statements(spark, d), X.txns(spark, d)).select("doc_id", "code", "severity", "emit", "sub")


@query("f14_bank_finding_text", sql("""
SELECT doc_id, format('Begin, deposits and withdrawals give ${:,.2f}, printed ${:,.2f}.', want/100.0, end_c/100.0) ||
       CASE WHEN ocr_used THEN ' Read by OCR, so a misread digit is possible.' ELSE '' END AS what FROM bank_f WHERE abs(want - end_c) > 2""", FINDINGS))
def bank_finding_text(spark, d):
    return B.bank_findings(X.statements(spark, d), X.txns(spark, d)).where(F.col("code") == "B_SUMMARY").select("doc_id", "what")


VERDICT = """
scored AS (
  SELECT s.doc_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h,
         count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l
  FROM {docs} s LEFT JOIN {findings} f ON f.doc_id = s.doc_id GROUP BY s.doc_id),
scores AS (SELECT *, 1 - pow(1-0.9::double, c) * pow(1-0.55::double, h) * pow(0.75::double, m) * pow(1-0.07::double, l) AS score FROM scored),
verdicts AS (
  SELECT *, CASE WHEN c > 0 OR h >= 2 OR score >= 0.85 THEN 'fail' WHEN h > 0 OR m >= 2 THEN 'review' ELSE 'pass' END AS verdict FROM scores)
"""


@query("statement_verdicts", sql("SELECT doc_id, verdict, cast(round_even(score * 100, 0) AS bigint) AS risk, round(score, 6) AS rule_score FROM verdicts",
                                 FINDINGS + "," + VERDICT.format(docs="d_statements", findings="bank_findings")))
def statement_verdicts(spark, d):
    s = X.statements(spark, d)
    v = score_documents(s, B.bank_findings(s, X.txns(spark, d)))
    return v.select("doc_id", "verdict", "risk", F.round("rule_score", 6).alias("rule_score"))
