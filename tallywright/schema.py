"""Schemas of the tables read and written, as DDL text; nothing is inferred."""

DOCUMENTS = "doc_id BIGINT, app_id BIGINT, filename STRING, sha256 STRING, size BIGINT, source STRING, status STRING, verdict STRING, decision STRING, created_at TIMESTAMP_NTZ"
APPLICATIONS = (
    "app_id BIGINT, org_id BIGINT, applicant_name STRING, property STRING, monthly_rent DECIMAL(18,2), training_consent BOOLEAN, "
    "consent_at TIMESTAMP_NTZ, consent_by STRING, created_at TIMESTAMP_NTZ")
ORGS = ("org_id BIGINT, org_name STRING, income_multiple DECIMAL(6,2)")
SPANS = (
    "doc_id BIGINT, page INT, span_no BIGINT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, font STRING, size DOUBLE")
OCR_WORDS = (
    "level INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, `left` INT, top INT, width INT, height INT, conf DOUBLE, text STRING")
STUBS = (
    "doc_id BIGINT, app_id BIGINT, filename STRING, sha256 STRING, employer STRING, employee STRING, applicant STRING, period_start DATE, period_end DATE, "
    "pay_date DATE, frequency STRING, frequency_stated BOOLEAN, gross DECIMAL(18,2), gross_ytd DECIMAL(18,2), net DECIMAL(18,2), net_ytd DECIMAL(18,2), "
    "total_deductions DECIMAL(18,2), ocr_used BOOLEAN, created TIMESTAMP_NTZ")
STUB_LINES = (
    "doc_id BIGINT, line_no BIGINT, kind STRING, label STRING, current DECIMAL(18,2), ytd DECIMAL(18,2), rate DECIMAL(18,2), hours DECIMAL(18,2)")
STATEMENTS = (
    "doc_id BIGINT, app_id BIGINT, filename STRING, holder STRING, applicant STRING, begin_balance DECIMAL(18,2), end_balance DECIMAL(18,2), "
    "total_deposits DECIMAL(18,2), total_withdrawals DECIMAL(18,2), text STRING, ocr_used BOOLEAN, verdict STRING")
BANK_TXNS = ("doc_id BIGINT, txn_no BIGINT, date DATE, desc STRING, amount DECIMAL(18,2), balance DECIMAL(18,2)")
AUDIT = ("org_id BIGINT, user_id BIGINT, action STRING, target STRING, detail STRING, at TIMESTAMP_NTZ")
