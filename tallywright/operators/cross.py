"""Findings that compare the documents of one application.

Every step reduces to distinct facts before it joins, so a hot application or a large group of copies
never multiplies: an application-month holds at most 31 pay dates and 496 clipped coverage intervals,
and an (application, day, dollar) bucket at most 100 distinct amounts a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions.text import lookup, names_match, usd
from tallywright.operators.findings import emit, finding
from tallywright.operators.ordered import top_k, with_previous
from tallywright.session import staged, together

CAT = {"category": "cross-document"}


def duplicate_files(documents: DataFrame) -> DataFrame:
    """Each later copy of a file points at the copy just before it in the same application."""
    d = documents.where(F.col("sha256").isNotNull()).select("app_id", "doc_id", "filename", "sha256")
    prev = with_previous(d, ["app_id", "sha256"], "doc_id", ["filename"], name="before")
    return emit(prev.where(F.col("before").isNotNull()), ["app_id", "doc_id"], (F.lit(True), finding(
        "X_DUP", "low", 200,
        F.concat(F.lit("\""), F.col("filename"), F.lit("\" is identical to \""), F.col("before.filename"), F.lit("\".")),
        ask="periods", **CAT)))


PAIR = ["doc_id", "filename", "employer", "pay_date", "net", "gross_ytd"]


def stub_pairs(reports: DataFrame) -> DataFrame:
    """Each stub that has not failed with the stub just before it, by pay date and then document."""
    ok = reports.where((F.col("doc_type") == "paystub") & F.col("pay_date").isNotNull()
                       & (F.coalesce("verdict", F.lit("")) != "fail"))
    ok = ok.select("app_id", *PAIR, "gross", "frequency")
    return with_previous(ok, ["app_id"], "doc_id", PAIR, outer="pay_date", name="a").where(F.col("a").isNotNull())


def pair_findings(pairs: DataFrame) -> DataFrame:
    a = lambda c: F.col(f"a.{c}")
    same_employer = a("employer").isNull() | F.col("employer").isNull() | F.coalesce(
        names_match(a("employer"), F.col("employer")), F.lit(False))
    same_day = a("pay_date") == F.col("pay_date")
    clash = same_day & ~a("net").eqNullSafe(F.col("net"))
    gap = F.datediff(F.col("pay_date"), a("pay_date"))
    days = lookup(K.PERIOD_DAYS, F.col("frequency"), 0)
    consecutive = (days > 0) & (gap <= days + 3)
    diff, gross = F.col("gross_ytd") - a("gross_ytd"), F.col("gross")
    testable = ~clash & diff.isNotNull() & gross.isNotNull() & (F.year(a("pay_date")) == F.year("pay_date"))
    order = F.unix_date("pay_date").cast("bigint")
    say = lambda v: F.coalesce(v.cast("string"), F.lit("none"))
    return emit(
        pairs.where(same_employer), ["app_id", "doc_id"],
        (clash, finding(
            "X_SAME_PERIOD", "high", 201,
            F.concat(F.lit("\""), a("filename"), F.lit("\" shows net "), say(a("net")), F.lit(", \""), F.col("filename"),
                     F.lit("\" shows "), say(F.col("net")), F.lit(" for "), F.col("pay_date").cast("string"), F.lit(".")),
            sub=order, ask="original", **CAT)),
        (testable & consecutive & (F.abs(diff - gross) > K.CENT_TOLERANCE), finding(
            "X_YTD", "high", 201,
            F.concat(F.lit("Year to date rose "), usd(diff), F.lit(" from "), a("pay_date").cast("string"), F.lit(" to "),
                     F.col("pay_date").cast("string"), F.lit(", but gross is "), usd(gross), F.lit(".")),
            variant="step", fix=F.concat(F.lit("Consecutive stubs whose step is the gross ("), usd(diff), F.lit(" by their totals).")),
            sub=order, ask="original", **CAT)),
        (testable & ~consecutive & (diff < gross - K.CENT_TOLERANCE), finding(
            "X_YTD", "high", 201,
            F.concat(F.lit("From "), a("pay_date").cast("string"), F.lit(" to "), F.col("pay_date").cast("string"),
                     F.lit(" year to date rose "), usd(diff), F.lit(", less than the gross of "), usd(gross), F.lit(".")),
            variant="gap", sub=order, ask="original", **CAT)),
    )


def coverage(statements: DataFrame, facts: DataFrame) -> DataFrame:
    """Pay dates a statement can vouch for: [first line, last line - 4 days], deposits present, not failed."""
    return (
        statements.where(F.coalesce("verdict", F.lit("")) != "fail").select("app_id", "doc_id", "filename")
        .join(facts.where(F.col("n_deposits") > 0).select("doc_id", "first_date", "last_date"), "doc_id")
        .select("app_id", F.col("doc_id").alias("stmt_id"), F.col("filename").alias("stmt_name"),
                F.col("first_date").alias("lo"), F.date_sub("last_date", K.COVERAGE_TAIL_DAYS).alias("hi"))
        .where(F.col("lo") <= F.col("hi"))
    )


def pay_events(reports: DataFrame) -> DataFrame:
    """Distinct (application, pay date, net). Failed stubs take part as well."""
    return reports.where((F.col("doc_type") == "paystub") & F.col("pay_date").isNotNull() & F.col("net").isNotNull()) \
        .select("app_id", "pay_date", "net").distinct()


def covering_statements(pays: DataFrame, cover: DataFrame) -> DataFrame:
    """First statement covering each (application, pay date)."""
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))
    by_month = cover.select("app_id", "lo", "hi", F.struct("stmt_id", "stmt_name").alias("s"), F.explode(months).alias("month"))
    clipped = (
        by_month.withColumn("lo", F.greatest("lo", "month")).withColumn("hi", F.least("hi", F.last_day("month")))
        .groupBy("app_id", "month", "lo", "hi").agg(F.min("s").alias("s"))
    )
    days = pays.select("app_id", "pay_date").distinct().withColumn("month", F.trunc("pay_date", "month"))
    hit = days.join(clipped, ["app_id", "month"]).where(F.col("pay_date").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("app_id", "pay_date").agg(F.min("s").alias("s")).select("app_id", "pay_date", "s.*")


def deposits_of(chain: DataFrame, cover: DataFrame) -> DataFrame:
    """Deposit lines of covering statements with the statement's coverage."""
    lines = chain.where(F.col("kind") == "deposit").select(F.col("doc_id").alias("stmt_id"), "txn_no", "date", "amount")
    return lines.join(cover, "stmt_id")


def deposit_matches(pays: DataFrame, deposits: DataFrame) -> DataFrame:
    """Last statement holding a deposit within 5 days and 1.00 of each pay event."""
    lo = F.greatest("lo", F.date_sub("date", K.DEPOSIT_DAYS))
    hi = F.least("hi", F.date_add("date", K.DEPOSIT_DAYS))
    stmt = F.struct("stmt_id", "stmt_name")
    per_day = (
        deposits.select("app_id", "date", "amount", lo.alias("a"), hi.alias("b"), stmt.alias("s")).where(F.col("a") <= F.col("b"))
        .groupBy("app_id", "date", "amount", "a", "b").agg(F.max("s").alias("s"))
        .select("app_id", "amount", "s", F.explode(F.sequence("a", "b")).alias("pay_date"))
        .groupBy("app_id", "pay_date", "amount").agg(F.max("s").alias("s"))
        .withColumn("dollar", F.floor("amount").cast("bigint"))
    )
    base = F.floor("net").cast("bigint")
    wanted = pays.withColumn("dollar", F.explode(F.array(base - 1, base, base + 1)))
    near = wanted.join(per_day, ["app_id", "pay_date", "dollar"]).where(F.abs(F.col("amount") - F.col("net")) <= K.DEPOSIT_TOLERANCE)
    return near.groupBy("app_id", "pay_date", "net").agg(F.max("s").alias("s")).select("app_id", "pay_date", "net", "s.*")


def nearby_deposits(days: DataFrame, deposits: DataFrame, k: int = 3) -> DataFrame:
    """The first k deposits within 5 days of each (application, pay date), in statement order, as text."""
    around = days.withColumn("date", F.explode(F.sequence(
        F.date_sub("pay_date", K.DEPOSIT_DAYS), F.date_add("pay_date", K.DEPOSIT_DAYS))))
    near = around.join(deposits, ["app_id", "date"]).where(F.col("pay_date").between(F.col("lo"), F.col("hi")))
    top = top_k(near, ["app_id", "pay_date"], [F.col("stmt_id"), F.col("txn_no")], k)
    return top.groupBy("app_id", "pay_date").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "amount"))), lambda x: usd(x["amount"])), ", ").alias("seen"))


def deposit_findings(reports: DataFrame, statements: DataFrame, chain: DataFrame, facts: DataFrame) -> DataFrame:
    """Stubs with and without a deposit that equals their net. What several steps read (coverage, pay dates, deposits) is a stage."""
    cover, pays = together(reports.sparkSession, lambda: staged(coverage(statements, facts), "coverage"), lambda: staged(pay_events(reports), "pay-dates"))
    first = covering_statements(pays, cover).withColumnsRenamed({"stmt_id": "cov_id", "stmt_name": "cov_name"})
    deposits = staged(deposits_of(chain, cover), "deposits")
    state = staged(
        pays.join(first, ["app_id", "pay_date"])
        .join(deposit_matches(pays, deposits), ["app_id", "pay_date", "net"], "left"), "deposit-matches"
    )
    open_days = state.where(F.col("stmt_id").isNull()).select("app_id", "pay_date").distinct()
    state = state.join(nearby_deposits(open_days, deposits), ["app_id", "pay_date"], "left")
    stubs = reports.where(F.col("doc_type") == "paystub").select("app_id", "doc_id", "filename", "pay_date", "net")
    d = stubs.join(state, ["app_id", "pay_date", "net"])
    order = F.unix_date("pay_date").cast("bigint")
    return emit(
        d, ["app_id", "doc_id"],
        (F.col("stmt_id").isNotNull(), finding(
            "X_DEPOSIT_OK", "info", 202,
            F.concat(F.lit("Net "), usd(F.col("net")), F.lit(" of \""), F.col("filename"), F.lit("\" is a deposit on \""),
                     F.col("stmt_name"), F.lit("\".")), sub=order, **CAT)),
        (F.col("stmt_id").isNull(), finding(
            "X_DEPOSIT", "medium", 202,
            F.concat(F.lit("\""), F.col("filename"), F.lit("\": net "), usd(F.col("net")), F.lit(" paid "), F.col("pay_date").cast("string"),
                     F.lit(" is not on \""), F.col("cov_name"), F.lit("\" (deposits within 5 days: "), F.coalesce("seen", F.lit("none")), F.lit(").")),
            sub=order, ask="account", **CAT)),
    )


def cross_findings(reports: DataFrame, statements: DataFrame, chain: DataFrame, facts: DataFrame) -> DataFrame:
    """All application-level findings. ``reports`` holds finished documents with their effective verdicts."""
    copies, pairs, deposits = together(reports.sparkSession, lambda: duplicate_files(reports), lambda: pair_findings(stub_pairs(reports)),
                                       lambda: deposit_findings(reports, statements, chain, facts))
    return copies.unionByName(pairs).unionByName(deposits)
