"""Screening tables derived from the driver's tables.

``SQL`` holds statements valid in both Spark and DuckDB (money is whole cents, so no engine rounds); the
DataFrame functions turn them into the library's input tables. Faults are planted by remainders of the
document number so that every rule both fires and stays silent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2001-06-30"
FIRST = "ana,ben,carla,david,elena,frank,grace,hugo"
LAST = "moreno,stone,alvarez,young,fischer,nakamura,okafor,quinn,russo"
BANK_BASE = 1_000_000_000_000


def _fl(expr: str, n: int) -> str:
    return f"(({expr}) DIV {n})"  # amounts are never negative


def _pick(words: str, expr: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', cast(({expr}) % {n} AS int) + 1)"


def _person(key: str) -> str:
    return f"concat({_pick(FIRST, key)}, ' ', {_pick(LAST, key)})"


_WHOLE = "k % 131 = 0"

D_APPS = f"""
SELECT c_custkey AS app_id, cast(c_nationkey AS bigint) AS org_id, {_person('c_custkey')} AS applicant_name,
       cast(floor(abs(c_acctbal) * 25) AS bigint) AS rent_c, c_custkey % 3 = 0 AS training_consent,
       concat('Unit ', c_mktsegment) AS property
FROM customer
"""

D_ORGS = """
SELECT cast(n_nationkey AS bigint) AS org_id, n_name AS org_name,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 200 + 25 * (n_nationkey % 7) END AS multiple_h
FROM nation
"""

_BASE = """
SELECT o_orderkey AS doc_id, o_orderkey AS k, o_custkey AS app_id, cast(o_orderdate AS date) AS pay_date,
       40000 + cast(floor(o_totalprice) AS bigint) AS g0
FROM orders
"""

_AMOUNTS = f"""
SELECT *, CASE WHEN k % 2 = 1 AND k % 9 > 0 THEN 2000 + (k % 30) * 50 END AS rate_c,
       CASE WHEN k % 2 = 1 AND k % 9 > 0 THEN (k % 9) * 100 END AS hours_c,
       CASE WHEN k % 2 = 1 AND k % 9 > 0 THEN (2000 + (k % 30) * 50) * (k % 9) END AS ot0,
       CASE WHEN {_WHOLE} THEN {_fl('g0 * 62', 100000)} * 100 ELSE {_fl('g0 * 62 + 500', 1000)} END AS ss_c,
       CASE WHEN {_WHOLE} THEN {_fl('g0 * 145', 1000000)} * 100 ELSE {_fl('g0 * 145 + 5000', 10000)} END AS med_c,
       CASE WHEN {_WHOLE} THEN {_fl('g0 * 11', 10000)} * 100 ELSE {_fl('g0 * 11', 100)} END AS fed_c,
       CASE WHEN k % 3 > 0 THEN 4500 + (k % 7) * 125 END AS health_c,
       CASE WHEN k % 5 = 0 THEN {_fl('g0 * 4', 100)} END AS k401_c,
       CASE WHEN k % 37 > 0 THEN {_pick('weekly,biweekly,semimonthly,monthly', 'k')} END AS frequency,
       CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 15 ELSE 30 END AS len_days
FROM ({_BASE}) b
"""

_PRINTED = f"""
SELECT *, ss_c + med_c + fed_c + coalesce(health_c, 0) + coalesce(k401_c, 0) AS ded_c,
       CASE WHEN k % 97 = 0 THEN 2 * g0 ELSE g0 END AS g1,
       1 + cast((dayofyear(pay_date) - 1) DIV len_days AS bigint) AS n_periods
FROM ({_AMOUNTS}) a
"""

D_WIDE = f"""
SELECT doc_id, app_id, k, pay_date, g0, rate_c, hours_c, ss_c, med_c, fed_c, health_c, k401_c, ded_c, n_periods,
       CASE WHEN k % 83 = 0 THEN ot0 + 1000 ELSE ot0 END AS ot_c, g0 - coalesce(ot0, 0) AS reg_c,
       CASE WHEN k % 151 > 0 THEN g1 END AS gross_c,
       CASE WHEN k % 151 = 0 OR k % 41 = 0 THEN NULL WHEN k % 103 = 0 THEN {_fl('g1', 2)}
            WHEN k % 107 = 0 THEN g1 * 70 ELSE g1 * n_periods END AS gross_ytd_c,
       CASE WHEN k % 67 = 0 THEN NULL WHEN k % 61 = 0 THEN ded_c + 500 ELSE ded_c END AS total_c,
       CASE WHEN k % 149 = 0 THEN NULL WHEN k % 97 = 0 THEN 2 * g0 - ded_c WHEN k % 101 = 0 THEN g0 - ded_c + 2000
            WHEN k % 137 = 0 THEN g0 - ded_c + 3 WHEN k % 139 = 0 THEN g0 - ded_c + 2
            ELSE g0 - ded_c END AS net_c,
       CASE WHEN k % 157 = 0 THEN ss_c - 100 ELSE ss_c * n_periods END AS ss_ytd_c,
       frequency, frequency IS NOT NULL AND k % 5 > 0 AS frequency_stated,
       pay_date - 5 AS period_end,
       CASE WHEN k % 109 = 0 THEN pay_date - 2 WHEN k % 113 = 0 THEN pay_date + 1
            WHEN k % 127 = 0 THEN pay_date - 29 ELSE pay_date - (len_days + 4) END AS period_start,
       CASE WHEN k % 89 = 0 THEN NULL WHEN k % 71 = 0 THEN 'somebody different'
            ELSE {_person('app_id')} END AS employee,
       CASE WHEN k % 79 = 0 THEN NULL WHEN k % 13 = 0 THEN 'Beta Trading Corp'
            ELSE concat('Acme Works ', {_pick('north,south,east,west', 'app_id')}) END AS employer,
       {_person('app_id')} AS applicant, k % 11 = 0 AS ocr_used,
       CASE WHEN k % 2 = 0 THEN pay_date - cast(k % 15 AS int) END AS created_on,
       CASE k % 10 WHEN 3 THEN 'fail' WHEN 4 THEN 'review' WHEN 5 THEN 'unreadable' ELSE 'pass' END AS verdict,
       CASE WHEN k % 19 = 0 THEN 'genuine' WHEN k % 23 = 0 THEN 'fraudulent' END AS decision,
       CASE k % 25 WHEN 7 THEN 'queued' WHEN 8 THEN 'processing' WHEN 9 THEN 'error' ELSE 'done' END AS status,
       concat('stub-', cast(doc_id AS string), '.pdf') AS filename
FROM ({_PRINTED}) p
"""

_YEAR_DOC = f"{BANK_BASE} + app_id * 100 + (cast(year(pay_date) AS bigint) - 1995)"
_PAID = "net_c + CASE WHEN k % 23 = 0 THEN 101 WHEN k % 5 = 0 THEN 90 ELSE 0 END"

# One deposit and one withdrawal per paid stub; line numbers leave no gaps inside a stub's pair.
D_TXN_PAIRS = f"""
SELECT {_YEAR_DOC} AS doc_id, app_id, k, {_PAID} AS amount_c,
       pay_date + cast(k % 7 AS int) AS paid_on, pay_date + (cast(k % 7 AS int) + 2) AS spent_on,
       100000 + {_PAID} AS paid_balance_c, CASE WHEN k % 211 = 0 THEN 102500 ELSE 100000 END AS spent_balance_c,
       CASE WHEN k % 3 = 0 THEN 'Acme payroll' WHEN k % 3 = 1 THEN 'Direct Deposit' ELSE 'Mobile item' END AS paid_desc
FROM ({D_WIDE}) w WHERE net_c IS NOT NULL
"""

D_STATEMENTS = f"""
SELECT doc_id, app_id, CASE WHEN app_id % 43 = 0 THEN 'somebody different' ELSE {_person('app_id')} END AS holder,
       CASE WHEN app_id % 19 > 0 THEN 100000 END AS begin_c,
       CASE WHEN app_id % 37 = 0 THEN NULL WHEN app_id % 29 = 0 THEN 101000 ELSE 100000 END AS end_c,
       CASE WHEN app_id % 31 = 0 THEN dep_c + 50000 ELSE dep_c END AS deposits_c, dep_c AS withdrawals_c,
       {_person('app_id')} AS applicant, app_id % 11 = 0 AS ocr_used,
       CASE WHEN app_id % 10 = 7 THEN 'fail' ELSE 'pass' END AS verdict,
       concat('bank-', cast(doc_id AS string), '.pdf') AS filename
FROM (SELECT doc_id, app_id, sum(amount_c) AS dep_c FROM ({D_TXN_PAIRS}) t GROUP BY doc_id, app_id) s
"""

D_SPANS = """
SELECT l_orderkey AS doc_id, cast(1 + l_linenumber % 2 AS int) AS page,
       cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 10000 + l_suppkey AS span_no,
       concat('t', cast(l_partkey % 17 AS string)) AS text,
       cast(l_partkey % 12 AS double) * 6 AS x0, cast(l_suppkey % 5 AS double) * 5 AS y0,
       cast(l_partkey % 12 AS double) * 6 + 6 + l_quantity AS x1, cast(l_suppkey % 5 AS double) * 5 + 10 AS y1,
       CASE WHEN l_partkey % 9 = 0 THEN 'ABCDEF+Courier-Bold' WHEN l_partkey % 2 = 0 THEN 'ArialMT'
            ELSE 'GHIJKL+Arial-BoldMT' END AS font,
       cast(floor(l_extendedprice * 100) AS bigint) AS amount_c, l_orderkey % 7 = 0 AS ocr
FROM lineitem
"""

D_FILES = """
SELECT doc_id, doc_id % 5 AS app_id, concat('f', cast(doc_id AS string), '.pdf') AS filename, text,
       cast(n_chars AS bigint) AS size,
       CASE WHEN doc_id % 9 = 0 THEN 'jpeg' WHEN doc_id % 31 = 0 THEN NULL ELSE 'pdf' END AS kind,
       CASE doc_id % 6 WHEN 0 THEN 'Sejda 3.2' WHEN 1 THEN 'Microsoft Word for Microsoft 365' WHEN 2 THEN 'PDFKit'
            WHEN 3 THEN 'Canva' WHEN 4 THEN '' ELSE NULL END AS producer,
       CASE doc_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Adobe Photoshop 2024' ELSE NULL END AS creator,
       CASE WHEN doc_id % 5 < 3 THEN concat('D:199803', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), '101500') END AS created,
       CASE WHEN doc_id % 5 < 2 THEN concat('D:199803', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), '10',
                                            lpad(cast(doc_id % 60 AS string), 2, '0'), '30') END AS modified,
       cast(1 + doc_id % 4 AS int) AS n_eof, doc_id % 3 = 0 AS linearized,
       CASE WHEN doc_id % 8 = 0 THEN 'GIMP 2.10' END AS exif_software
FROM documents
"""

D_CELLS = """
SELECT page_id, rw, cl, cast(min(q) AS double) / 100 AS ink_frac, cast(max(q) + 20 AS double) AS contrast,
       cast(sum(q) % 97 AS double) AS noise, cast(min(q) AS double) / 50 AS p
FROM (SELECT l_suppkey AS page_id, cast(l_partkey % 40 AS int) AS rw, cast(l_orderkey % 40 AS int) AS cl,
             cast(l_quantity AS bigint) AS q FROM lineitem) x
GROUP BY page_id, rw, cl
"""

D_SCORED = """
SELECT d.doc_id, d.lang AS kind, l.quality AS y, l.toxic AS toxic,
       cast(d.n_chars % 101 AS double) / 100 AS score,
       CASE WHEN d.n_chars % 3 = 0 THEN 'fail' WHEN d.n_chars % 3 = 1 THEN 'review' ELSE 'pass' END AS verdict
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

VIEWS = {
    "d_apps": D_APPS, "d_orgs": D_ORGS, "d_wide": D_WIDE, "d_txn_pairs": D_TXN_PAIRS,
    "d_statements": D_STATEMENTS, "d_spans": D_SPANS, "d_files": D_FILES, "d_cells": D_CELLS, "d_scored": D_SCORED,
}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of narrow rows from each of which much is worked out, with the key they are dealt by.
DEALT = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table spread over all cores: a file of few row groups is read by few tasks, which would then do all the work on its rows."""
    rows = table(spark, sf_dir, name)
    if name not in DEALT:
        return rows
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), DEALT[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame over the given folder."""
    sql = VIEWS[name]
    for t in TABLES:
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            dealt(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def money(cents: str):
    return (F.col(cents).cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_wide").select(
        "doc_id", "app_id", "filename", "verdict", "decision", "status", "employer", "employee", "applicant",
        "period_start", "period_end", "pay_date", "frequency", "frequency_stated", "ocr_used",
        F.col("created_on").cast("timestamp_ntz").alias("created"),
        *[money(f"{c}_c").alias(a) for c, a in
          (("gross", "gross"), ("gross_ytd", "gross_ytd"), ("net", "net"), ("total", "total_deductions"))],
        F.when(F.col("gross_ytd_c").isNotNull(), (money("net_c") * F.col("n_periods")).cast("decimal(18,2)")).alias("net_ytd"),
    )


def stub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earning and deduction lines, in print order."""
    none = F.lit(None).cast("decimal(18,2)")

    def line(no, kind, label, amount, ytd=None, rate=None, hours=None):
        return F.when(F.col(amount).isNotNull(), F.struct(
            F.lit(no).cast("bigint").alias("line_no"), F.lit(kind).alias("kind"), F.lit(label).alias("label"),
            money(amount).alias("current"), (money(ytd) if ytd else none).alias("ytd"),
            (money(rate) if rate else none).alias("rate"), (money(hours) if hours else none).alias("hours")))

    lines = F.array(
        line(1, "earning", "regular", "reg_c"),
        line(2, "earning", "overtime", "ot_c", None, "rate_c", "hours_c"),
        line(3, "deduction", "federal income tax", "fed_c"),
        line(4, "deduction", "social security", "ss_c", "ss_ytd_c"),
        line(5, "deduction", "medicare", "med_c"),
        line(6, "deduction", "health insurance", "health_c"),
        line(7, "deduction", "401(k)", "k401_c"),
    )
    wide = view(spark, sf_dir, "d_wide")
    return wide.select("doc_id", lines.alias("_lines")).select("doc_id", F.inline_outer("_lines")).where(F.col("line_no").isNotNull())


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_statements").select(
        "doc_id", "app_id", "filename", "verdict", "holder", "applicant", "ocr_used",
        money("begin_c").alias("begin_balance"), money("end_c").alias("end_balance"),
        money("deposits_c").alias("total_deposits"), money("withdrawals_c").alias("total_withdrawals"),
        F.concat(F.lit("Statement for "), F.col("holder")).alias("text"),
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(odd, day, desc, balance):
        return F.struct((F.col("k") * 2 + odd).alias("txn_no"), F.col(day).alias("date"), desc.alias("desc"),
                        money("amount_c").alias("amount"), money(balance).alias("balance"))

    pairs = F.array(line(0, "paid_on", F.col("paid_desc"), "paid_balance_c"),
                    line(1, "spent_on", F.lit("Card purchase"), "spent_balance_c"))
    return view(spark, sf_dir, "d_txn_pairs").select("doc_id", "app_id", pairs.alias("_pairs")).select("doc_id", "app_id", F.inline_outer("_pairs"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_apps").select(
        "app_id", "org_id", "applicant_name", "property", "training_consent", money("rent_c").alias("monthly_rent"))


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_orgs").select(
        "org_id", "org_name", (F.col("multiple_h").cast("decimal(6,2)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast("decimal(6,2)").alias("income_multiple"))


# The same tables for the oracle, as common table expressions.
ORACLE_VIEWS = {
    **{k: v.replace("AS string)", "AS varchar)").replace(" DIV ", " // ") for k, v in VIEWS.items()},
}
ORACLE_VIEWS["o_lines"] = """
SELECT doc_id, 1 AS line_no, 'earning' AS kind, 'regular' AS label, reg_c AS cur, NULL::bigint AS ytd, NULL::bigint AS rate, NULL::bigint AS hours FROM d_wide WHERE reg_c IS NOT NULL
UNION ALL SELECT doc_id, 2, 'earning', 'overtime', ot_c, NULL, rate_c, hours_c FROM d_wide WHERE ot_c IS NOT NULL
UNION ALL SELECT doc_id, 3, 'deduction', 'federal income tax', fed_c, NULL, NULL, NULL FROM d_wide WHERE fed_c IS NOT NULL
UNION ALL SELECT doc_id, 4, 'deduction', 'social security', ss_c, ss_ytd_c, NULL, NULL FROM d_wide WHERE ss_c IS NOT NULL
UNION ALL SELECT doc_id, 5, 'deduction', 'medicare', med_c, NULL, NULL, NULL FROM d_wide WHERE med_c IS NOT NULL
UNION ALL SELECT doc_id, 6, 'deduction', 'health insurance', health_c, NULL, NULL, NULL FROM d_wide WHERE health_c IS NOT NULL
UNION ALL SELECT doc_id, 7, 'deduction', '401(k)', k401_c, NULL, NULL, NULL FROM d_wide WHERE k401_c IS NOT NULL
"""
ORACLE_VIEWS["o_txns"] = """
SELECT doc_id, app_id, k * 2 AS txn_no, paid_on AS dt, paid_desc AS descr, amount_c, paid_balance_c AS balance_c FROM d_txn_pairs
UNION ALL SELECT doc_id, app_id, k * 2 + 1, spent_on, 'Card purchase', amount_c, spent_balance_c FROM d_txn_pairs
"""
_NEEDS = {"o_lines": ["d_wide"], "o_txns": ["d_txn_pairs"]}


def with_views(body: str, *names: str) -> str:
    """Oracle SQL: the named derived views as CTEs in front of ``body`` (which may hold CTEs itself)."""
    order: list[str] = []
    for n in names:
        for need in [*_NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    head = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


# --- rendered documents ----------------------------------------------------

def _usd(cents: str):
    from tallywright.functions.text import usd
    return usd(money(cents))


def _spans_of(df: DataFrame, spans: list) -> DataFrame:
    """(text column, x, y, size, condition) entries to span rows on page 1."""
    recs = []
    for i, (text, x, y, size, cond) in enumerate(spans):
        pos = [v if hasattr(v, "cast") else F.lit(float(v)) for v in (x, y)]
        recs.append(F.struct(F.lit(i).cast("bigint").alias("span_no"), (text if cond is None else F.when(cond, text)).alias("text"),
                             pos[0].alias("x0"), pos[1].alias("y0"), F.lit(float(size)).alias("size")))
    # the array is a column of its own so that it is compiled; inside the generator it would be interpreted
    flat = df.select("doc_id", F.array(*recs).alias("_spans")).select("doc_id", F.inline_outer("_spans")).where(F.col("text").isNotNull())
    return flat.select("doc_id", F.lit(1).alias("page"), "span_no", "text", "x0", "y0", (F.col("x0") + F.length("text") * 5.0).alias("x1"),
                       (F.col("y0") + F.col("size")).alias("y1"), F.lit("Courier").alias("font"), "size")


def stub_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stub printed as positioned text: labels, side-by-side columns, both column orders."""
    w = view(spark, sf_dir, "d_wide")
    yes, lit, c = None, F.lit, F.col
    swap = c("k") % 7 == 0
    w = w.withColumn("net_ytd_c", F.when(c("gross_ytd_c").isNotNull(), c("net_c") * c("n_periods")))
    amounts = ["reg_c", "fed_c", "rate_c", "ot_c", "ss_c", "ss_ytd_c", "med_c", "health_c", "k401_c", "gross_c", "gross_ytd_c", "total_c", "net_c", "net_ytd_c"]
    w = w.select("*", *[_usd(a).alias(f"s_{a}") for a in amounts])
    shown = lambda a: c(f"s_{a}")
    one = lambda cur, ytd: (F.when(swap & c(ytd).isNotNull(), shown(ytd)).otherwise(shown(cur)),
                            F.when(swap & c(ytd).isNotNull(), shown(cur)).otherwise(shown(ytd)))
    name = lambda i: F.split_part(c("employee"), lit(" "), lit(i))
    has = lambda col: c(col).isNotNull()
    labelled = (c("k") % 2 == 0) & has("employer")
    ot = has("ot_c")
    lines = [
        (F.when(labelled, lit("Employer:")), 40, 20, 9, yes), (F.when(labelled, c("employer")), 100, 20, 9, yes),
        (F.when(~labelled, F.coalesce(c("employer"), lit("Delta Letterhead Ltd"))), 40, 40, 16, yes),
        (lit("Employee:"), 40, 80, 9, has("employee")), (name(1), 95, 80, 9, has("employee")), (name(2), 124, 80, 9, has("employee")),
        (lit("Employee ID:"), 400, 80, 9, has("employee")), (lit("E-77"), 470, 80, 9, has("employee")),
        (lit("Pay Date:"), 40, 100, 9, yes), (F.date_format("pay_date", "MM/dd/yyyy"), 100, 100, 9, yes),
        (lit("Pay Period:"), 40, 120, 9, yes), (c("period_start").cast("string"), 100, 120, 9, yes), (lit("-"), 170, 120, 9, yes),
        (c("period_end").cast("string"), 180, 120, 9, yes),
        (lit("Pay Frequency:"), 40, 140, 9, c("frequency_stated")), (F.initcap("frequency"), 120, 140, 9, c("frequency_stated")),
        (lit("Earnings"), 40, 240, 9, yes), (F.when(swap, lit("YTD")).otherwise(lit("Current")), 200, 240, 9, yes),
        (F.when(swap, lit("Current")).otherwise(lit("YTD")), 300, 240, 9, yes),
        (lit("Regular"), 40, 260, 9, yes), (shown("reg_c"), 120, 260, 9, yes),
        (lit("Federal Income Tax"), 330, 261, 9, yes), (shown("fed_c"), 450, 262, 9, yes),
        (lit("Overtime"), 40, 280, 9, ot), (shown("rate_c"), 120, 280, 9, ot), (F.format_number(money("hours_c"), 2), 170, 280, 9, ot), (shown("ot_c"), 230, 281, 9, ot),
        (lit("Social Security"), 330, 280, 9, yes), (one("ss_c", "ss_ytd_c")[0], 450, 280, 9, yes), (one("ss_c", "ss_ytd_c")[1], 520, 280, 9, yes),
        (lit("Medicare"), 40, 300, 9, yes), (shown("med_c"), 120, 300, 9, yes),
        (lit("Health Insurance"), 40, 320, 9, has("health_c")), (shown("health_c"), 150, 320, 9, yes),
        (lit("401(k)"), 40, 340, 9, has("k401_c")), (shown("k401_c"), 120, 340, 9, yes),
        (lit("Gross Pay"), 40, 360, 9, has("gross_c")), (one("gross_c", "gross_ytd_c")[0], 120, 360, 9, has("gross_c")), (one("gross_c", "gross_ytd_c")[1], 220, 360, 9, has("gross_c")),
        (lit("Total Deductions"), 40, 380, 9, has("total_c")), (shown("total_c"), 150, 380, 9, yes),
        (lit("Net Pay"), 40, 400, 9, has("net_c")), (one("net_c", "net_ytd_c")[0], 120, 400, 9, has("net_c")), (one("net_c", "net_ytd_c")[1], 220, 400, 9, has("net_c")),
    ]
    return _spans_of(w, lines)


def stub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def statement_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement printed: holder, summary, then one row per line."""
    yes, lit, c = None, F.lit, F.col
    has = lambda col: c(col).isNotNull()
    head = _spans_of(view(spark, sf_dir, "d_statements"), [
        (lit("Account Holder:"), 40, 20, 9, yes), (c("holder"), 130, 20, 9, yes), (lit("Account Number"), 400, 20, 9, yes), (lit("xx-77"), 480, 20, 9, yes),
        (lit("Beginning Balance"), 40, 40, 9, has("begin_c")), (_usd("begin_c"), 200, 40, 9, yes),
        (lit("Total Deposits"), 40, 60, 9, yes), (_usd("deposits_c"), 200, 60, 9, yes),
        (lit("Total Withdrawals"), 40, 80, 9, yes), (_usd("withdrawals_c"), 200, 80, 9, yes),
        (lit("Ending Balance"), 40, 100, 9, has("end_c")), (_usd("end_c"), 200, 100, 9, yes),
    ])
    from tallywright.functions.text import usd
    t = txns(spark, sf_dir).withColumn("y", 200.0 + c("txn_no") * 12.0)
    body = _spans_of(t.withColumn("k", c("txn_no")), [
        (F.date_format("date", "M/d/yyyy"), 40, c("y"), 9, yes), (c("desc"), 120, c("y"), 9, yes),
        (usd(c("amount")), 300, c("y"), 9, yes), (usd(c("balance")), 400, c("y"), 9, yes),
    ])
    return head.unionByName(body)
