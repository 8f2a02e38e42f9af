"""Queries over applications: cross-document findings, income, rollup and the service's projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions import text as T
from tallywright.operators import bank_rules as B
from tallywright.operators import cross as C
from tallywright.operators import decide as D
from tallywright.operators import income as I
from tallywright.operators import portfolio as P
from tallywright.operators.findings import describe
from tallywright.plans import fixtures as X
from tallywright.plans import statements as ST
from tallywright.plans import stubs as SB
from tallywright.plans.registry import query
from tallywright.session import staged

# Finished stubs with the verdict a reviewer may have replaced.
REPORTS = """
reports AS (
  SELECT *, CASE WHEN decision = 'genuine' THEN 'pass' WHEN decision IS NOT NULL THEN 'fail' ELSE verdict END AS eff
  FROM d_wide WHERE status IN ('done', 'error')),
pairs0 AS (
  SELECT app_id, doc_id, pay_date, net_c, gross_c, gross_ytd_c, employer, frequency,
         lag(doc_id) OVER w AS a_doc, lag(pay_date) OVER w AS a_date, lag(net_c) OVER w AS a_net,
         lag(gross_ytd_c) OVER w AS a_ytd, lag(employer) OVER w AS a_emp
  FROM reports WHERE eff <> 'fail' WINDOW w AS (PARTITION BY app_id ORDER BY pay_date, doc_id)),
pairs AS (SELECT *, date_diff('day', a_date, pay_date) AS gap, gross_ytd_c - a_ytd AS diff,
          CASE frequency WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'semimonthly' THEN 15 WHEN 'monthly' THEN 30 ELSE 0 END AS per
          FROM pairs0 WHERE a_doc IS NOT NULL),
same_emp AS (SELECT *, per > 0 AND gap <= per + 3 AS consecutive, pay_date = a_date AND net_c IS DISTINCT FROM a_net AS clash
             FROM pairs WHERE a_emp IS NULL OR employer IS NULL OR a_emp = employer),
pair_findings AS (
  SELECT app_id, doc_id, 'X_SAME_PERIOD' AS code, 'high' AS severity, '' AS variant FROM same_emp WHERE clash
  UNION ALL SELECT app_id, doc_id, 'X_YTD', 'high', CASE WHEN consecutive THEN 'step' ELSE 'gap' END FROM same_emp
  WHERE NOT clash AND year(a_date) = year(pay_date) AND gross_c IS NOT NULL AND
        CASE WHEN consecutive THEN abs(diff - gross_c) > 2 ELSE diff < gross_c - 2 END)
"""
DEPOSITS = ST.FACTS + "," + REPORTS + """,
cover AS (
  SELECT s.app_id, s.doc_id AS stmt_id, s.filename AS stmt_name, first_date AS lo, last_date - 4 AS hi
  FROM d_statements s JOIN facts USING (doc_id) WHERE s.verdict <> 'fail' AND n_dep > 0),
covered AS (
  SELECT r.app_id, r.doc_id, r.net_c, r.pay_date, c.stmt_id, c.stmt_name FROM reports r JOIN cover c
  ON r.app_id = c.app_id AND r.pay_date BETWEEN c.lo AND c.hi WHERE net_c IS NOT NULL),
near AS (
  SELECT v.*, t.txn_no, t.amount_c, abs(t.amount_c - v.net_c) <= 100 AS match FROM covered v JOIN chain t
  ON t.doc_id = v.stmt_id AND t.kind = 'deposit' AND abs(date_diff('day', t.dt, v.pay_date)) <= 5),
hits AS (SELECT doc_id, max(stmt_id) AS hit FROM near WHERE match GROUP BY doc_id),
deposit_findings AS (
  SELECT v.app_id, v.doc_id, min(v.stmt_id) AS first_stmt, max(hit) AS hit FROM covered v LEFT JOIN hits USING (doc_id) GROUP BY v.app_id, v.doc_id)
"""
CROSS = DEPOSITS + """,
cross_findings AS (
  SELECT app_id, doc_id, code, severity FROM pair_findings
  UNION ALL SELECT app_id, doc_id, CASE WHEN hit IS NULL THEN 'X_DEPOSIT' ELSE 'X_DEPOSIT_OK' END, CASE WHEN hit IS NULL THEN 'medium' ELSE 'info' END FROM deposit_findings)
"""


def sql(body: str, parts: str = REPORTS) -> str:
    return X.with_views("WITH " + parts + "\n" + body, "o_txns", "d_statements", "d_apps", "d_orgs", "d_wide")


def reports(spark, d):
    """Finished stub reports; every stub has its own hash, so copies come from the documents table instead."""
    r = P.finished(X.stubs(spark, d))
    return r.withColumn("doc_type", F.lit("paystub")).withColumn("sha256", F.sha2(F.col("doc_id").cast("string"), 256))


def bank(spark, d):
    """Statements, their chain and facts. Several later steps read each of them, so they are stages (a checkpoint works its rows out twice)."""
    s = staged(X.statements(spark, d), "statements")
    chain = staged(B.balance_chain(X.txns(spark, d), s), "bank-lines")
    return s, chain, staged(B.statement_facts(chain), "bank-facts")


def between(spark, d):
    """Findings between the documents of an application. Reports are a stage: pairs, pay dates and stubs all come from them."""
    s, chain, facts = bank(spark, d)
    return C.cross_findings(staged(reports(spark, d), "reports"), s, chain, facts)


@query("w3_consecutive_stubs", sql("SELECT app_id, doc_id, a_doc AS before_doc, gap FROM pairs"))
def consecutive(spark, d):
    p = C.stub_pairs(reports(spark, d))
    return p.select("app_id", "doc_id", F.col("a.doc_id").alias("before_doc"), F.datediff("pay_date", "a.pay_date").alias("gap"))


@query("r51_r53_pair_findings", sql("SELECT app_id, doc_id, code, severity, variant FROM pair_findings"))
def pair_findings(spark, d):
    return C.pair_findings(C.stub_pairs(reports(spark, d))).select("app_id", "doc_id", "code", "severity", "variant")


@query("r52_x_ytd", sql("SELECT variant, count(*) AS n FROM pair_findings WHERE code = 'X_YTD' GROUP BY variant"))
def x_ytd(spark, d):
    f = C.pair_findings(C.stub_pairs(reports(spark, d))).where(F.col("code") == "X_YTD")
    return f.groupBy("variant").agg(F.count("*").alias("n"))


@query("j3_covering_statement", sql("SELECT DISTINCT app_id, cast(pay_date AS varchar) AS pay_date, first_value(stmt_id) OVER (PARTITION BY app_id, pay_date ORDER BY stmt_id) AS stmt_id FROM covered", DEPOSITS))
def covering(spark, d):
    s, chain, facts = bank(spark, d)
    return C.covering_statements(C.pay_events(reports(spark, d)), C.coverage(s, facts)).select("app_id", "pay_date", "stmt_id")


@query("j4_deposit_band", sql("SELECT app_id, cast(pay_date AS varchar) AS pay_date, net_c/100.0 AS net, max(stmt_id) AS stmt_id FROM near WHERE match GROUP BY app_id, pay_date, net_c", DEPOSITS))
def deposit_band(spark, d):
    s, chain, facts = bank(spark, d)
    dep = C.deposits_of(chain, C.coverage(s, facts))
    return C.deposit_matches(C.pay_events(reports(spark, d)), dep).select("app_id", "pay_date", "net", "stmt_id")


@query("r54_r55_deposit_findings", sql("SELECT app_id, doc_id, CASE WHEN hit IS NULL THEN 'X_DEPOSIT' ELSE 'X_DEPOSIT_OK' END AS code FROM deposit_findings", DEPOSITS))
def deposit_findings(spark, d):
    s, chain, facts = bank(spark, d)
    return C.deposit_findings(staged(reports(spark, d), "reports"), s, chain, facts).select("app_id", "doc_id", "code")


@query("o6_nearby_deposits", sql("""
SELECT app_id, cast(pay_date AS varchar) AS pay_date, string_agg(format('${:,.2f}', amount_c/100.0), ', ' ORDER BY stmt_id, txn_no) AS seen
FROM (SELECT DISTINCT app_id, pay_date, stmt_id, txn_no, amount_c FROM near) n2
WHERE (app_id, pay_date) IN (SELECT (app_id, pay_date) FROM covered v LEFT JOIN hits USING (doc_id) WHERE hit IS NULL)
  AND (SELECT count(*) FROM (SELECT DISTINCT app_id, pay_date, stmt_id, txn_no FROM near) m WHERE m.app_id = n2.app_id AND m.pay_date = n2.pay_date AND (m.stmt_id, m.txn_no) < (n2.stmt_id, n2.txn_no)) < 3
GROUP BY app_id, pay_date""", DEPOSITS))
def nearby(spark, d):
    s, chain, facts = bank(spark, d)
    cover, pays = C.coverage(s, facts), C.pay_events(reports(spark, d))
    dep = C.deposits_of(chain, cover)
    hit = C.deposit_matches(pays, dep).select("app_id", "pay_date", "net")
    days = pays.join(hit, ["app_id", "pay_date", "net"], "left_anti").join(
        C.covering_statements(pays, cover), ["app_id", "pay_date"], "left_semi").select("app_id", "pay_date").distinct()
    return C.nearby_deposits(days, dep)


@query("cross_findings", sql("SELECT app_id, doc_id, code, severity FROM cross_findings", CROSS))
def cross(spark, d):
    return between(spark, d).select("app_id", "doc_id", "code", "severity")


@query("w4_r50_duplicate_files", X.with_views("""
SELECT app_id, doc_id, lag(filename) OVER (PARTITION BY app_id, text ORDER BY doc_id) AS before FROM d_files QUALIFY before IS NOT NULL""", "d_files"))
def duplicates(spark, d):
    docs = X.view(spark, d, "d_files").select("app_id", "doc_id", "filename", F.sha2("text", 256).alias("sha256"))
    f = C.duplicate_files(docs)
    return f.select("app_id", "doc_id", F.regexp_extract("what", 'identical to "(.*)"', 1).alias("before"))


INCOME = REPORTS + """,
inputs AS (
  SELECT app_id, doc_id, eff, pay_date, gross_ytd_c, eff IN ('fail', 'unreadable') AS excluded,
         gross_c * CASE frequency WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 WHEN 'semimonthly' THEN 24 WHEN 'monthly' THEN 12 END AS annual
  FROM reports WHERE gross_c IS NOT NULL),
agg AS (
  SELECT app_id, count(*) FILTER (NOT excluded AND annual IS NOT NULL) AS n, count(*) FILTER (excluded) AS n_excluded,
         sum(annual) FILTER (NOT excluded) AS total FROM inputs GROUP BY app_id),
latest AS (SELECT app_id, pay_date, gross_ytd_c FROM inputs WHERE NOT excluded AND gross_ytd_c IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY pay_date DESC, doc_id) = 1),
inc AS (
  SELECT a.app_id, coalesce(g.n, 0) AS n, coalesce(g.n_excluded, 0) AS n_excluded, g.total, a.rent_c, coalesce(o.multiple_h, 300) AS mult,
         CASE WHEN g.n > 0 AND dayofyear(l.pay_date) / 365::double * 12 >= 1 THEN l.gross_ytd_c::hugeint * 365 END AS ytd_num, dayofyear(l.pay_date) * 12 AS ytd_den
  FROM d_apps a LEFT JOIN d_orgs o USING (org_id) LEFT JOIN agg g USING (app_id) LEFT JOIN latest l USING (app_id))
"""


def half_even(num: str, den: str) -> str:
    """num/den to a whole number, half to even, in integers only."""
    return (f"(CASE WHEN 2 * (({num}) % ({den})) > ({den}) OR (2 * (({num}) % ({den})) = ({den}) AND (({num}) // ({den})) % 2 = 1) "
            f"THEN ({num}) // ({den}) + 1 ELSE ({num}) // ({den}) END)")


@query("d5_d7_income", sql(f"""
SELECT app_id, n AS n_used, n_excluded,
       CASE WHEN n > 0 THEN {half_even('total::hugeint', '12 * n::hugeint')} / 100.0 END AS monthly_gross,
       CASE WHEN n > 0 THEN {half_even('total::hugeint', 'n::hugeint')} / 100.0 END AS annual_gross,
       CASE WHEN ytd_num IS NOT NULL THEN {half_even('ytd_num', 'ytd_den')} / 100.0 END AS ytd_monthly,
       CASE WHEN n > 0 AND rent_c > 0 THEN {half_even('rent_c::hugeint * mult', '100')} / 100.0 END AS required_monthly,
       CASE WHEN n > 0 AND rent_c > 0 THEN {half_even('100 * total::hugeint', '12 * n::hugeint * rent_c')} / 100.0 END AS income_to_rent,
       CASE WHEN n > 0 AND rent_c > 0 THEN total::hugeint * 100 >= rent_c::hugeint * mult * 12 * n END AS meets_requirement
FROM inc""", INCOME))
def income(spark, d):
    return I.income(reports(spark, d), X.applications(spark, d), X.orgs(spark, d)).drop("policy", "notes")


@query("d8_income_notes", sql("""
SELECT app_id, (CASE WHEN n_excluded > 0 THEN 1 ELSE 0 END) + (SELECT (count(*) > 0)::int FROM inputs i WHERE i.app_id = inc.app_id AND NOT excluded AND annual IS NULL)
   + (SELECT (count(*) > 0)::int FROM inputs i WHERE i.app_id = inc.app_id AND eff = 'review' AND annual IS NOT NULL)
   + coalesce((n > 0 AND ytd_num * 12 * n * 100 < total * 85 * ytd_den)::int, 0) AS n_notes FROM inc""", INCOME))
def income_notes(spark, d):
    i = I.income(reports(spark, d), X.applications(spark, d), X.orgs(spark, d))
    return i.select("app_id", F.size("notes").alias("n_notes"))


@query("d8_income_note_rows", sql("""
SELECT app_id, 0::bigint AS place, i.doc_id, filename || ': not annualised, how often it is paid is unknown.' AS note FROM inputs i JOIN d_wide w USING (app_id, doc_id) WHERE NOT excluded AND annual IS NULL
UNION ALL SELECT app_id, 1, NULL, 'The average of the year to date is below recent pay.' FROM inc WHERE n > 0 AND ytd_num * 12 * n * 100 < total * 85 * ytd_den
UNION ALL SELECT app_id, 2, NULL, 'Provisional: some documents still wait for review.' FROM (SELECT DISTINCT app_id FROM inputs WHERE eff = 'review' AND annual IS NOT NULL)
UNION ALL SELECT app_id, 3, NULL, 'Documents that failed do not count.' FROM inc WHERE n_excluded > 0""", INCOME))
def income_note_rows(spark, d):
    return I.income_notes(reports(spark, d), X.applications(spark, d), X.orgs(spark, d))


@query("d5_income_inputs", sql(f"""
SELECT doc_id, CASE WHEN excluded THEN 'excluded' WHEN annual IS NULL THEN 'unknown_frequency' ELSE 'used' END AS use,
       CASE WHEN annual IS NOT NULL THEN {half_even('annual::hugeint', '12')} / 100.0 END AS monthly FROM inputs""", INCOME))
def income_inputs(spark, d):
    return I.income_inputs(reports(spark, d)).select("doc_id", "use", "monthly")


@query("w11_latest_stub", sql("SELECT app_id, cast(pay_date AS varchar) AS pay_date, gross_ytd_c/100.0 AS gross_ytd FROM latest", INCOME))
def latest_stub(spark, d):
    x = I.income_inputs(reports(spark, d)).where((F.col("use") != "excluded") & F.col("gross_ytd").isNotNull())
    best = F.max_by(F.struct("pay_date", "gross_ytd"), F.struct(F.col("pay_date"), -F.col("doc_id"))).alias("s")
    return x.groupBy("app_id").agg(best).select("app_id", "s.*")


ROLLUP = CROSS + """,
xs AS (SELECT app_id, count(*) FILTER (severity='high') AS h, count(*) FILTER (severity='medium') AS m FROM cross_findings GROUP BY app_id),
xr AS (SELECT app_id, CASE WHEN h >= 2 OR 1 - pow(1-0.55::double, h) * pow(0.75::double, m) >= 0.85 THEN 2 WHEN h > 0 OR m >= 2 THEN 1 ELSE 0 END AS r FROM xs),
dr AS (SELECT app_id, max(CASE eff WHEN 'fail' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) AS r, count(*) AS n_done FROM reports GROUP BY app_id),
cnt AS (SELECT app_id, count(*) AS n_docs, bool_or(status IN ('queued', 'processing')) AS pending FROM d_wide GROUP BY app_id)
"""


@query("d4_rollup", sql("""
SELECT app_id, n_docs, pending, coalesce(n_done, 0) AS n_done, CASE WHEN n_done > 0 THEN list_extract(['pass', 'review', 'fail'], cast(greatest(dr.r, coalesce(xr.r, 0)) + 1 AS int)) END AS verdict
FROM cnt LEFT JOIN dr USING (app_id) LEFT JOIN xr USING (app_id)""", ROLLUP))
def rollup(spark, d):
    return P.rollup(X.stubs(spark, d), between(spark, d))


@query("a6_worst_verdict", sql("SELECT app_id, CASE max(CASE eff WHEN 'fail' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS verdict FROM reports GROUP BY app_id"))
def worst(spark, d):
    none = C.pair_findings(C.stub_pairs(reports(spark, d))).where("false")
    return P.rollup(X.stubs(spark, d), none).where("n_done > 0").select("app_id", "verdict")


@query("a8_document_counts", sql("SELECT app_id, count(*) AS n_docs, bool_or(status IN ('queued', 'processing')) AS pending FROM d_wide GROUP BY app_id"))
def document_counts(spark, d):
    return P.document_counts(X.stubs(spark, d))


NEEDS = SB.RULES + "," + CROSS + "," + SB._FIXES + """,
doc_needs AS (
  SELECT DISTINCT app_id, 'D:' || code || '/' || emit AS need FROM t5 JOIN reports USING (doc_id) WHERE eff <> 'pass' AND (severity <> 'medium' OR NOT major)),
all_needs AS (SELECT * FROM doc_needs UNION SELECT app_id, 'X:' || code FROM cross_findings WHERE severity IN ('high', 'medium'))
"""


@query("a13_application_needs", sql("SELECT app_id, need FROM all_needs", NEEDS))
def application_needs(spark, d):
    docs = X.stubs(spark, d)
    f = SB.findings(spark, d).withColumn("fix", F.concat(F.lit("D:"), "code", F.lit("/"), "emit"))
    x = between(spark, d).withColumn("fix", F.concat(F.lit("X:"), "code"))
    return P.application_needs(D.needs_to_pass(f), docs, x).select("app_id", "need")


@query("a13_application_requests", sql("""
SELECT DISTINCT app_id, 'D:' || code AS request FROM stub_findings JOIN reports USING (doc_id) WHERE eff <> 'pass' AND severity <> 'info'
UNION SELECT app_id, 'X:' || code FROM cross_findings WHERE severity IN ('high', 'medium')""", NEEDS))
def application_requests(spark, d):
    docs = X.stubs(spark, d)
    f = SB.findings(spark, d).withColumn("applicant_request", F.concat(F.lit("D:"), "code"))
    asks = D.applicant_requests(f, docs.select("doc_id", F.lit("review").alias("verdict")))
    x = between(spark, d).withColumn("applicant_request", F.concat(F.lit("X:"), "code"))
    return P.application_requests(asks, docs, x).select("app_id", "request")


# --- projections, filters and joins of the service -------------------------

@query("p1_upload_validation", X.with_views("""
SELECT doc_id, reject_reason, coalesce(bool_or(reject_reason IN ('too_large', 'unknown_type')) OVER (PARTITION BY a, b), false) AS request_rejected FROM (
SELECT doc_id, app_id // 2 AS a, doc_id // 97 AS b, CASE WHEN row_number() OVER (PARTITION BY app_id // 2, doc_id // 97 ORDER BY doc_id) > 10 THEN 'too_many_files' WHEN size * 1000 > 15728640 THEN 'too_large' WHEN size = 0 THEN 'empty'
            WHEN kind IS NULL THEN 'unknown_type' END AS reject_reason FROM d_files) x""", "d_files"))
def upload_validation(spark, d):
    f = X.view(spark, d, "d_files")
    up = f.select("doc_id", F.concat_ws("-", F.floor(F.col("app_id") / 2), F.floor(F.col("doc_id") / 97)).alias("request_id"),
                  F.col("doc_id").alias("seq"), "filename", (F.col("size") * 1000).alias("size"), "kind")
    return P.validate_uploads(up).select("doc_id", "reject_reason", "request_rejected")


@query("p2_public_cap", sql("SELECT a.app_id, count(doc_id) AS n_docs FROM d_apps a LEFT JOIN d_wide USING (app_id) GROUP BY a.app_id HAVING count(doc_id) < 30"))
def public_cap(spark, d):
    return P.open_for_public_upload(X.stubs(spark, d), X.applications(spark, d)).select("app_id", "n_docs")


@query("p3_tenant_scope", sql("SELECT doc_id, filename FROM d_wide WHERE app_id IN (SELECT app_id FROM d_apps WHERE org_id = 7)"))
def tenant_scope(spark, d):
    return P.tenant_documents(X.stubs(spark, d), X.applications(spark, d), 7).select("doc_id", "filename")


@query("p6_finished_documents", sql("SELECT doc_id, eff AS verdict FROM reports"))
def finished(spark, d):
    return P.finished(X.stubs(spark, d)).select("doc_id", "verdict")


@query("p7_trainable", sql("SELECT doc_id, cast(decision = 'fraudulent' AS bigint) AS label FROM d_wide JOIN d_apps USING (app_id) WHERE decision IS NOT NULL AND training_consent AND verdict <> 'unreadable'"))
def trainable(spark, d):
    docs = X.stubs(spark, d).withColumn("features", F.when(F.col("verdict") != "unreadable", F.array(F.lit(1.0))))
    return P.trainable(docs, X.applications(spark, d)).select("doc_id", "label")


@query("p13_effective_verdict", sql("SELECT doc_id, CASE WHEN decision = 'genuine' THEN 'pass' WHEN decision IS NOT NULL THEN 'fail' ELSE verdict END AS verdict FROM d_wide"))
def effective(spark, d):
    return X.stubs(spark, d).select("doc_id", P.effective_verdict(F.col("decision"), F.col("verdict")).alias("verdict"))


@query("p14_document_rows", sql("""
SELECT doc_id, filename, status, v AS verdict, verdict AS engine_verdict, decision IS NOT NULL AS reviewed,
  CASE v WHEN 'pass' THEN 'No problems found' WHEN 'review' THEN 'Needs a closer look' WHEN 'fail' THEN 'Failed verification' ELSE 'Could not be read' END AS headline
FROM (SELECT *, CASE WHEN decision = 'genuine' THEN 'pass' WHEN decision IS NOT NULL THEN 'fail' ELSE verdict END AS v FROM d_wide) x"""))
def document_rows(spark, d):
    return P.document_rows(X.stubs(spark, d)).drop("app_id")


@query("p16_applicant_view", sql("""
SELECT doc_id, filename, CASE WHEN status IN ('queued','processing') THEN 'Checking' WHEN decision = 'genuine' OR (decision IS NULL AND verdict = 'pass') THEN 'Received' ELSE 'More information needed' END AS state FROM d_wide"""))
def applicant_view(spark, d):
    return P.applicant_view(X.stubs(spark, d)).drop("app_id")


@query("p17_apply_reviews", """
WITH r AS (SELECT l_orderkey AS doc_id, max_by(d, q) AS d FROM (
  SELECT l_orderkey, list_extract(['genuine','fraudulent','clear','other'], cast(l_partkey % 4 + 1 AS int)) AS d, cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 10000 + l_suppkey AS q FROM lineitem) x
  WHERE d <> 'other' GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN d <> 'clear' THEN d END AS decision FROM orders LEFT JOIN r ON doc_id = o_orderkey""")
def reviews(spark, d):
    words = F.array(*[F.lit(w) for w in ("genuine", "fraudulent", "clear", "other")])
    r = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"),
        F.element_at(words, (F.col("l_partkey") % 4 + 1).cast("int")).alias("decision"), F.lit("note").alias("notes"),
        F.lit("analyst").alias("by"), F.col("l_shipdate").alias("at"))
    docs = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("string").alias("decision"))
    return P.apply_reviews(docs, r).select("doc_id", "decision")


@query("p18_consent", """
WITH e AS (SELECT user_id AS app_id, arg_max(event_type IN ('signup','purchase'), event_id) AS training, arg_max(event_type, event_id) AS who FROM events GROUP BY 1)
SELECT c_custkey AS app_id, coalesce(training, false) AS training_consent, who AS consent_by FROM customer LEFT JOIN e ON app_id = c_custkey""")
def consent(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("app_id"), F.col("event_id").alias("seq"),
                                           F.col("event_type").isin("signup", "purchase").alias("training"), F.col("event_type").alias("who"), F.col("ts").alias("at"))
    apps = X.table(spark, d, "customer").select(F.col("c_custkey").alias("app_id"))
    return P.apply_consent(apps, e).select("app_id", "training_consent", "consent_by")


@query("p19_cascade_delete", sql("SELECT doc_id FROM d_wide WHERE app_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')"))
def cascade_delete(spark, d):
    gone = X.table(spark, d, "events").where(F.col("event_type") == "error").select(F.col("user_id").alias("app_id"))
    return P.delete_applications(X.applications(spark, d), X.stubs(spark, d), gone)[1].select("doc_id")


@query("j1_document_application", sql("SELECT doc_id, applicant_name, property FROM d_wide JOIN d_apps USING (app_id)"))
def doc_app(spark, d):
    return X.stubs(spark, d).join(X.applications(spark, d), "app_id").select("doc_id", "applicant_name", "property")


@query("j2_application_org", sql("SELECT app_id, org_name, coalesce(multiple_h, 300)/100.0 AS multiple FROM d_apps JOIN d_orgs USING (org_id)"))
def app_org(spark, d):
    o = X.orgs(spark, d)
    return X.applications(spark, d).join(o, "org_id").select("app_id", "org_name", F.coalesce("income_multiple", F.lit(3)).cast("double").alias("multiple"))


@query("j12_wage_base", "SELECT event_id, CASE 2010 + event_id % 20 WHEN 2023 THEN 160200 WHEN 2024 THEN 168600 WHEN 2025 THEN 176100 ELSE 184500 END AS cap, CASE event_type WHEN 'view' THEN 0 ELSE -1 END AS rank FROM events")
def wage_base(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", T.lookup(K.SS_WAGE_BASE, (F.col("event_id") % 20 + 2010), max(K.SS_WAGE_BASE.values())).alias("cap"),
                    T.lookup({"view": 0}, F.col("event_type"), -1).alias("rank"))


@query("o2_newest_applications", sql("SELECT app_id, applicant_name FROM d_apps WHERE org_id = 3 ORDER BY app_id DESC LIMIT 300"))
def newest(spark, d):
    return P.newest_applications(X.applications(spark, d), 3).select("app_id", "applicant_name")


@query("a15_label_counts", sql("SELECT count(*) AS labelled_documents, count(*) FILTER (training_consent AND verdict <> 'unreadable') AS consented_documents FROM d_wide JOIN d_apps USING (app_id) WHERE decision IS NOT NULL"))
def label_counts(spark, d):
    docs = X.stubs(spark, d).withColumn("has_features", F.col("verdict") != "unreadable")
    return P.label_counts(docs, X.applications(spark, d))


@query("findings_described", sql("SELECT code, count(*) AS n, true AS complete FROM cross_findings GROUP BY code", CROSS))
def described(spark, d):
    f = describe(between(spark, d))
    return f.groupBy("code").agg(F.count("*").alias("n"), F.bool_and(F.col("title").isNotNull() & F.col("why").isNotNull() & F.col("fix").isNotNull() & F.col("what").isNotNull()).alias("complete"))


@query("j13_statement_checks", X.with_views("""
WITH b AS (SELECT s.*, (SELECT count(*) FROM d_txn_pairs t WHERE t.doc_id = s.doc_id) AS n FROM d_statements s)
SELECT doc_id, coalesce(begin_c, 0) <> 0 AND n > 0 AS can_running,
       coalesce(begin_c, 0) <> 0 AND coalesce(end_c, 0) <> 0 AND coalesce(deposits_c, 0) <> 0 AND coalesce(withdrawals_c, 0) <> 0 AS can_summary, applicant <> '' AS can_name FROM b""", "d_txn_pairs", "d_statements"))
def statement_checks(spark, d):
    s, _, facts = bank(spark, d)
    return D.statement_applicability(s, facts)
