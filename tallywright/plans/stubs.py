"""Queries over pay stubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.operators import decide as D
from tallywright.operators import stub_rules as S
from tallywright.operators.findings import describe
from tallywright.plans import fixtures as X
from tallywright.plans.registry import query
from tallywright.plans.statements import VERDICT

# Independent statement of the stub rules over the wide view, in cents.
RULES = """
w AS (
  SELECT *, CASE WHEN gross_ytd_c IS NOT NULL THEN net_c * n_periods END AS net_ytd_c,
         date_diff('day', period_start, period_end) + 1 AS len, DATE '%(today)s' AS today,
         reg_c + coalesce(ot_c, 0) AS earn_c, coalesce(health_c, 0) AS pretax_c,
         3 + (health_c IS NOT NULL)::int + (k401_c IS NOT NULL)::int AS n_ded,
         dayofyear(pay_date) AS doy, CASE frequency WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 WHEN 'semimonthly' THEN 24 WHEN 'monthly' THEN 12 END AS py
  FROM d_wide),
w2 AS (SELECT *, coalesce(total_c, ded_c) AS used_c, cast(ceil(doy / 365::double * py) AS bigint) + 1 AS elapsed FROM w),
stub_findings AS (
  SELECT doc_id, 'C_MISSING' AS code, 'medium' AS severity, 50 AS emit, 0 AS sub FROM w2 WHERE gross_c IS NULL OR net_c IS NULL OR employee IS NULL OR employer IS NULL
  UNION ALL SELECT doc_id, 'C_NET_MATH', CASE WHEN ocr_used THEN 'medium' WHEN total_c IS NULL THEN 'high' ELSE 'critical' END, 51, 0 FROM w2 WHERE abs(gross_c - used_c - net_c) > 2
  UNION ALL SELECT doc_id, 'C_DED_SUM', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 52, 0 FROM w2 WHERE abs(ded_c - total_c) > 2
  UNION ALL SELECT doc_id, 'C_EARN_SUM', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 53, 0 FROM w2 WHERE abs(earn_c - gross_c) > 2
  UNION ALL SELECT doc_id, 'C_RATE_HOURS', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 54, 2 FROM w2 WHERE abs(rate_c * hours_c / 100 - ot_c) > 5
  UNION ALL SELECT doc_id, 'C_FICA_SS', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 55, 0 FROM w2 WHERE gross_c IS NOT NULL AND coalesce(gross_ytd_c, 0) <= 18450000
      AND (ss_c * 1000 < 62 * (gross_c - pretax_c) - 3000 OR ss_c * 1000 > 62 * gross_c + 3000)
  UNION ALL SELECT doc_id, 'C_FICA_MED', CASE WHEN ocr_used THEN 'medium' ELSE 'high' END, 56, 0 FROM w2 WHERE gross_c IS NOT NULL AND coalesce(gross_ytd_c, 0) <= 20000000
      AND (med_c * 10000 < 145 * (gross_c - pretax_c) - 30000 OR med_c * 10000 > 145 * gross_c + 30000)
  UNION ALL SELECT doc_id, 'C_YTD_LT', CASE WHEN ocr_used THEN 'medium' ELSE 'critical' END, 57, 0 FROM w2 WHERE coalesce(gross_ytd_c + 2 < gross_c, false) OR coalesce(net_ytd_c + 2 < net_c, false) OR ss_ytd_c + 2 < ss_c
  UNION ALL SELECT doc_id, 'C_YTD_PACE', 'medium', 58, 0 FROM w2 WHERE gross_ytd_c / gross_c::double > (elapsed + 2) * 1.3::double
  UNION ALL SELECT doc_id, 'C_DATES', 'high', 59, 0 FROM w2 WHERE period_end < period_start
  UNION ALL SELECT doc_id, 'C_FUTURE', 'high', 60, 0 FROM w2 WHERE pay_date > today + 3
  UNION ALL SELECT doc_id, 'C_STALE', 'low', 61, 0 FROM w2 WHERE date_diff('day', pay_date, today) > 90
  UNION ALL SELECT doc_id, 'C_DATES', 'medium', 62, 0 FROM w2 WHERE pay_date < period_start
  UNION ALL SELECT doc_id, 'C_PERIOD', 'medium', 63, 0 FROM w2 WHERE frequency_stated AND NOT CASE frequency
      WHEN 'weekly' THEN len BETWEEN 6 AND 8 WHEN 'biweekly' THEN len BETWEEN 13 AND 15 WHEN 'semimonthly' THEN len BETWEEN 13 AND 16 ELSE len BETWEEN 28 AND 31 END
  UNION ALL SELECT doc_id, 'C_PREDATED', 'medium', 64, 0 FROM w2 WHERE date_diff('day', created_on, pay_date) > 10
  UNION ALL SELECT doc_id, 'C_ROUND', 'low', 65, 0 FROM w2 WHERE (gross_c IS NOT NULL)::int + (net_c IS NOT NULL)::int + n_ded >= 4
      AND coalesce(gross_c, 0) %% 100 = 0 AND coalesce(net_c, 0) %% 100 = 0 AND ss_c %% 100 = 0 AND med_c %% 100 = 0 AND fed_c %% 100 = 0
      AND coalesce(health_c, 0) %% 100 = 0 AND coalesce(k401_c, 0) %% 100 = 0
  UNION ALL SELECT doc_id, 'C_NAME', 'high', 66, 0 FROM w2 WHERE employee <> applicant)
""" % {"today": X.TODAY}
VERDICTS = RULES + "," + VERDICT.format(docs="d_wide", findings="stub_findings")


def sql(body: str, parts: str = RULES) -> str:
    return X.with_views("WITH " + parts + "\n" + body, "o_lines", "d_wide")


def facts(spark, d):
    return S.with_facts(X.stubs(spark, d), X.stub_lines(spark, d))


def findings(spark, d):
    return S.all_stub_findings(X.stubs(spark, d), X.stub_lines(spark, d), X.TODAY)


def of(*codes):
    def run(spark, d):
        return findings(spark, d).where(F.col("code").isin(*codes)).select("doc_id", "code", "severity")
    return run


def of_sql(*codes):
    names = ", ".join(f"'{c}'" for c in codes)
    return sql(f"SELECT doc_id, code, severity FROM stub_findings WHERE code IN ({names})")


for _name, _codes in {
    "r20_missing": ["C_MISSING"], "r21_net_math": ["C_NET_MATH"], "r22_deduction_sum": ["C_DED_SUM"],
    "r23_earning_sum": ["C_EARN_SUM"], "r24_rate_hours": ["C_RATE_HOURS"], "r25_social_security": ["C_FICA_SS"],
    "r26_medicare": ["C_FICA_MED"], "r27_ytd_below_current": ["C_YTD_LT"], "r28_ytd_pace": ["C_YTD_PACE"],
    "r29_r32_dates": ["C_DATES"], "r30_future": ["C_FUTURE"], "r31_stale": ["C_STALE"], "r33_period_length": ["C_PERIOD"],
    "r34_predated": ["C_PREDATED"], "r35_round": ["C_ROUND"], "r36_name": ["C_NAME"],
}.items():
    query(_name, of_sql(*_codes))(of(*_codes))


@query("stub_findings", sql("SELECT doc_id, code, severity, emit, sub FROM stub_findings"))
def stub_findings(spark, d):
    return findings(spark, d).select("doc_id", "code", "severity", "emit", "sub")


@query("r25_r26_implied_gross", sql("""
SELECT doc_id, code, CASE code WHEN 'C_FICA_SS' THEN round_even(cast(ss_c AS decimal(18,2)) * 1000 / 62, 0) / 100.0 ELSE round_even(cast(med_c AS decimal(18,2)) * 10000 / 145, 0) / 100.0 END AS implied_gross
FROM stub_findings JOIN d_wide USING (doc_id) WHERE code IN ('C_FICA_SS', 'C_FICA_MED')"""))
def implied_gross(spark, d):
    return findings(spark, d).where(F.col("code").startswith("C_FICA")).select("doc_id", "code", "implied_gross")


@query("a1_line_sums", X.with_views("""
SELECT doc_id, count(*) FILTER (kind = 'deduction') AS n_ded, sum(cur) FILTER (kind = 'deduction')/100.0 AS ded_sum,
       count(*) FILTER (kind = 'earning') AS n_earn, sum(cur) FILTER (kind = 'earning')/100.0 AS earn_sum,
       coalesce(sum(cur) FILTER (kind = 'deduction' AND regexp_matches(label, 'health|medical|dental|vision|hsa|fsa')), 0)/100.0 AS pretax_sum
FROM o_lines GROUP BY doc_id""", "o_lines"))
def line_sums(spark, d):
    return S.line_facts(X.stub_lines(spark, d)).select("doc_id", "n_ded", "ded_sum", "n_earn", "earn_sum", "pretax_sum")


@query("w7_first_tax_line", X.with_views("""
SELECT doc_id, arg_min(cur, line_no) FILTER (regexp_matches(label, 'social sec|oasdi|fica.?ss'))/100.0 AS ss_tax,
       arg_min(cur, line_no) FILTER (regexp_matches(label, 'medicare|fica.?med'))/100.0 AS medicare_tax
FROM o_lines WHERE kind = 'deduction' GROUP BY doc_id""", "o_lines"))
def first_tax_line(spark, d):
    return S.line_facts(X.stub_lines(spark, d)).select("doc_id", "ss_tax", "medicare_tax")


@query("a14_missing_list", sql("""
SELECT doc_id, concat_ws(', ', CASE WHEN gross_c IS NULL THEN 'gross pay' END, CASE WHEN net_c IS NULL THEN 'net pay' END,
       CASE WHEN employee IS NULL THEN 'employee name' END, CASE WHEN employer IS NULL THEN 'employer name' END) AS missing
FROM w2 WHERE gross_c IS NULL OR net_c IS NULL OR employee IS NULL OR employer IS NULL"""))
def missing_list(spark, d):
    f = findings(spark, d).where(F.col("code") == "C_MISSING")
    return f.select("doc_id", F.array_join("detail", ", ").alias("missing"))


@query("f8_elapsed_periods", sql("SELECT doc_id, elapsed FROM w2 WHERE py IS NOT NULL"))
def elapsed(spark, d):
    from tallywright.functions.text import lookup
    s = X.stubs(spark, d).where(F.col("frequency").isNotNull())
    return s.select("doc_id", S.elapsed_periods(F.col("pay_date"), lookup(K.PERIODS_PER_YEAR, F.col("frequency"))).alias("elapsed"))


@query("a4_rule_score", sql("SELECT doc_id, round(score, 6) AS rule_score FROM verdicts", VERDICTS))
def rule_scores(spark, d):
    v = D.score_documents(X.stubs(spark, d), findings(spark, d))
    return v.select("doc_id", F.round("rule_score", 6).alias("rule_score"))


@query("a5_severity_counts", sql("SELECT doc_id, count(*) FILTER (severity='critical') AS n_critical, count(*) FILTER (severity='high') AS n_high, count(*) FILTER (severity='medium') AS n_medium, count(*) FILTER (severity='low') AS n_low FROM stub_findings GROUP BY doc_id"))
def severity_counts(spark, d):
    return D.severity_counts(findings(spark, d), ["doc_id"]).select("doc_id", "n_critical", "n_high", "n_medium", "n_low")


@query("d1_verdict", sql("SELECT doc_id, verdict, CASE verdict WHEN 'pass' THEN 'No problems found' WHEN 'review' THEN 'Needs a closer look' ELSE 'Failed verification' END AS headline FROM verdicts", VERDICTS))
def verdicts(spark, d):
    return D.score_documents(X.stubs(spark, d), findings(spark, d)).select("doc_id", "verdict", "headline")


@query("d2_risk", sql("""
SELECT doc_id, cast(round_even(100 * CASE WHEN score > 0.2 THEN greatest(score, p) ELSE (score + p) / 2 END, 0) AS bigint) AS risk,
       CASE WHEN c > 0 OR h >= 2 OR score >= 0.85 OR (p >= 0.9 AND h > 0) THEN 'fail' WHEN h > 0 OR m >= 2 OR p >= 0.5 THEN 'review' ELSE 'pass' END AS verdict
FROM (SELECT *, (doc_id % 101) / 100::double AS p FROM verdicts) v""", VERDICTS))
def risk(spark, d):
    s = X.stubs(spark, d)
    p = s.select("doc_id", ((F.col("doc_id") % 101) / F.lit(100.0)).alias("probability"))
    return D.score_documents(s, findings(spark, d), p).select("doc_id", "risk", "verdict")


@query("d3_ocr_downgrade", sql("SELECT code, severity, count(*) AS n FROM stub_findings JOIN d_wide USING (doc_id) WHERE ocr_used GROUP BY code, severity"))
def ocr_downgrade(spark, d):
    s = X.stubs(spark, d).where("ocr_used")
    f = S.all_stub_findings(s, X.stub_lines(spark, d), X.TODAY)
    return f.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("o1_finding_order", sql("SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, emit, sub) AS rank FROM stub_findings QUALIFY rank <= 5"))
def finding_order(spark, d):
    from tallywright.operators.portfolio import finding_top
    return finding_top(findings(spark, d)).select("doc_id", "code", "rank")


_FIXES = """
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, emit, sub) AS rn
        FROM stub_findings WHERE severity IN ('critical', 'high', 'medium')),
t5 AS (SELECT *, bool_or(severity <> 'medium') OVER (PARTITION BY doc_id) AS major FROM top WHERE rn <= 5)
"""


@query("a12_needs_codes", sql("SELECT doc_id, count(*) AS n_decisive FROM t5 WHERE severity <> 'medium' OR NOT major GROUP BY doc_id", RULES + "," + _FIXES))
def needs(spark, d):
    # Every fix text is unique per code here except C_DATES, so distinct needs are counted through it.
    f = findings(spark, d).withColumn("fix", F.concat_ws("/", "code", "emit"))
    return D.needs_to_pass(f).select("doc_id", F.size("needs").alias("n_decisive"))


@query("a12_applicant_requests", sql("""
SELECT doc_id, count(DISTINCT CASE
   WHEN code IN ('C_FICA_SS','C_FICA_MED','C_ROUND') THEN 'connect' WHEN code = 'C_NAME' THEN 'name' WHEN code IN ('C_FUTURE','C_STALE') THEN 'recent'
   WHEN code = 'C_YTD_PACE' THEN 'consecutive' WHEN code IN ('C_DATES','C_PERIOD','C_PREDATED') THEN 'original'
   WHEN ocr_used THEN 'clear' WHEN code = 'C_MISSING' THEN 'full' ELSE 'original' END) AS n_asks
FROM stub_findings JOIN d_wide USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM verdicts WHERE verdict <> 'pass') GROUP BY doc_id""", VERDICTS))
def asks(spark, d):
    f = describe(findings(spark, d))
    v = D.score_documents(X.stubs(spark, d), findings(spark, d))
    return D.applicant_requests(f, v).select("doc_id", F.size("asks").alias("n_asks"))


@query("a12_failed_because", sql("SELECT code, count(*) AS n FROM stub_findings WHERE severity IN ('critical','high','medium') GROUP BY code"))
def failed_because(spark, d):
    from tallywright.operators.findings import CATALOG
    title_code = {t[0]: c for (c, v), t in CATALOG.items()}
    f = D.failed_because(describe(findings(spark, d)))
    from tallywright.functions.text import lookup
    return f.groupBy(lookup(title_code, F.col("title")).alias("code")).agg(F.count("*").alias("n"))


_FLAGS = ", ".join(f"max((f.code = '{c}')::int)::double AS {c}" for c in K.FEATURE_CODES)


@query("a9_code_flags", sql(f"SELECT s.doc_id, {', '.join(f'coalesce({c}, 0.0::double) AS {c}' for c in K.FEATURE_CODES)} FROM d_wide s LEFT JOIN (SELECT doc_id, {_FLAGS} FROM stub_findings f GROUP BY doc_id) f USING (doc_id)"))
def code_flags(spark, d):
    docs = X.stubs(spark, d).select("doc_id", "ocr_used", F.lit(1).alias("n_eof"), F.lit("pdf").alias("kind"))
    return D.feature_rows(docs, findings(spark, d)).select("doc_id", *K.FEATURE_CODES)


@query("a10_numeric_features", sql("""
SELECT s.doc_id, round(least(coalesce(max(abs(gross_c - used_c - net_c) / greatest(gross_c, 100)::double) FILTER (code = 'C_NET_MATH'), 0), 2), 9) AS rel_net_err,
       (1 + s.doc_id % 8 > 6)::int * 6.0::double + (1 + s.doc_id % 8 <= 6)::int * (1 + s.doc_id % 8)::double AS n_revisions,
       s.ocr_used::int::double AS ocr_used, count(f.code)::double AS n_findings, 1.0::double AS is_pdf,
       round(least(coalesce(max(abs(CASE code WHEN 'C_FICA_SS' THEN round_even(cast(ss_c AS decimal(18,2)) * 1000 / 62, 0) WHEN 'C_FICA_MED' THEN round_even(cast(med_c AS decimal(18,2)) * 10000 / 145, 0) END - gross_c) / gross_c::double), 0), 2), 9) AS rel_fica_err,
       CASE WHEN s.doc_id % 5 = 0 THEN 0 ELSE s.doc_id % 4 END::double AS n_money_fonts
FROM w2 s LEFT JOIN stub_findings f ON f.doc_id = s.doc_id GROUP BY s.doc_id, s.ocr_used"""))
def numeric_features(spark, d):
    docs = X.stubs(spark, d).select("doc_id", "ocr_used", (F.col("doc_id") % 8 + 1).cast("int").alias("n_eof"), F.lit("pdf").alias("kind"))
    fonts = docs.where("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 4).alias("n_families"))
    f = D.feature_rows(docs, findings(spark, d), fonts)
    return f.select("doc_id", *[F.round(c, 9).alias(c) for c in ("rel_net_err", "rel_fica_err")], "n_revisions", "n_money_fonts", "ocr_used", "n_findings", "is_pdf")


@query("j13_passed_checks", sql("""
SELECT doc_id, code FROM (
  SELECT doc_id, unnest([
    CASE WHEN gross_c IS NOT NULL AND net_c IS NOT NULL THEN 'C_NET_MATH' END, CASE WHEN total_c IS NOT NULL THEN 'C_DED_SUM' END,
    CASE WHEN gross_c IS NOT NULL THEN 'C_EARN_SUM' END, CASE WHEN ot_c IS NOT NULL THEN 'C_RATE_HOURS' END,
    CASE WHEN gross_c IS NOT NULL THEN 'C_FICA_SS' END, CASE WHEN gross_c IS NOT NULL THEN 'C_FICA_MED' END,
    CASE WHEN gross_ytd_c IS NOT NULL THEN 'C_YTD_LT' END, 'C_FUTURE', CASE WHEN employee IS NOT NULL THEN 'C_NAME' END]) AS code FROM w2) a
WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stub_findings f WHERE f.doc_id = a.doc_id AND (f.code = a.code OR (f.code = 'C_STALE' AND a.code = 'C_FUTURE')))"""))
def passed(spark, d):
    x = facts(spark, d)
    return D.passed_checks(D.stub_applicability(x), findings(spark, d)).select("doc_id", "code")


@query("f14_stub_finding_text", sql("""
SELECT doc_id, 'Gross ' || format('${:,.2f}', gross_c/100.0) || ' less ' || format('${:,.2f}', used_c/100.0) || ' is ' || format('${:,.2f}', (gross_c-used_c)/100.0)
  || ', net is printed as ' || format('${:,.2f}', net_c/100.0) || ' (' || format('${:,.2f}', abs(gross_c-used_c-net_c)/100.0) || ' off).' AS what
FROM w2 WHERE abs(gross_c - used_c - net_c) > 2 AND NOT ocr_used"""))
def stub_text(spark, d):
    f = S.stub_findings(facts(spark, d).where(~F.col("ocr_used")), X.TODAY)
    return f.where(F.col("code") == "C_NET_MATH").select("doc_id", "what")


@query("f14_ocr_stub_finding_text", sql("""
SELECT doc_id, 'Gross ' || format('${:,.2f}', gross_c/100.0) || ' less ' || format('${:,.2f}', used_c/100.0) || ' is ' || format('${:,.2f}', (gross_c-used_c)/100.0)
  || ', net is printed as ' || format('${:,.2f}', net_c/100.0) || ' (' || format('${:,.2f}', abs(gross_c-used_c-net_c)/100.0) || ' off).'
  || CASE WHEN ocr_used THEN ' Read by OCR, so a misread digit is possible; compare the marked figures.' ELSE '' END AS what
FROM w2 WHERE abs(gross_c - used_c - net_c) > 2"""))
def any_stub_text(spark, d):
    """The wording of `f14_stub_finding_text` for every stub, those read by OCR with their note."""
    f = S.stub_findings(facts(spark, d), X.TODAY)
    return f.where(F.col("code") == "C_NET_MATH").select("doc_id", "what")
