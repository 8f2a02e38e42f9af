"""Rows to typed fields: document type, dates, names, pay lines, bank lines and summaries.

Everything row-local is a narrow expression; what a document says first comes out of one
map-side-combined aggregate of ``min_by`` over (page, at).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions import text as T
from tallywright.functions.text import lookup
from tallywright.operators.ordered import top_k, with_rank
from tallywright.operators.rows import STYLE, document_text, with_amounts, with_name, with_segments
from tallywright.session import never_broadcast, staged

WHERE = ("page", "at")


def first(value: Column, cond: Column | None = None) -> Column:
    key = F.struct(*WHERE)
    return F.min_by(value, key if cond is None else F.when(cond, key))


def doc_type(flags_stub: Column, flags_bank: Column) -> Column:
    return F.when((flags_stub >= 3) & (flags_stub >= flags_bank), "paystub").when(flags_bank >= 3, "bank_statement").otherwise("unknown")


def keyword_score(text: Column, words: list[str]) -> Column:
    low, score = F.lower(text), F.lit(0)
    for w in words:
        score = score + low.contains(w).cast("int")
    return score


def classify_text(text: Column) -> Column:
    return doc_type(keyword_score(text, K.STUB_WORDS), keyword_score(text, K.BANK_WORDS))


def classify(rows: DataFrame) -> DataFrame:
    """Type per document from its rows. No keyword holds a line break, so rows can be tested one by one."""
    low = F.lower("text")
    seen = [F.max(low.contains(w)).cast("int").alias(f"k{i}") for i, w in enumerate(K.STUB_WORDS + K.BANK_WORDS)]
    add = lambda names: sum((F.col(n) for n in names), F.lit(0))
    n = len(K.STUB_WORDS)
    k = [f"k{i}" for i in range(n + len(K.BANK_WORDS))]
    d = rows.groupBy("doc_id").agg(*seen)
    return d.select("doc_id", add(k[:n]).alias("stub_words"), add(k[n:]).alias("bank_words"),
                    doc_type(add(k[:n]), add(k[n:])).alias("doc_type"))


# --- dates -----------------------------------------------------------------

def with_dates(rows: DataFrame) -> DataFrame:
    """Add ``dates``: the ``(role, date)`` pairs of a row; roles are pay_date, period_start, period_end.

    Built in steps, each a column of its own, so no pattern runs twice on a row.
    """
    text = F.col("text")
    possible = text.rlike(r"\p{Nd}") & (text.contains("/") | text.contains("-") | text.rlike(r"\p{Nd}{4}"))  # cheap tests first: every form of a date has one of these
    r = rows.withColumn("_said", F.when(possible & T.has(text, K.DATE, True), T.date_strings(text)))
    r = r.withColumn("_lead", F.when(F.col("_said").isNotNull(), T.texts_before_dates(F.lower(text))))
    r = r.withColumn("_all", F.transform("_said", lambda m, i: F.struct(T.mention_to_date(m).alias("day"), F.get("_lead", i).alias("lead"))))
    r = r.withColumn("_found", F.filter("_all", lambda x: x["day"].isNotNull()))
    entry = lambda role, day: F.struct(F.lit(role).alias("role"), day.alias("day"))
    periodic = F.lower(text).contains("period")

    def roles(x, i):
        lead, nxt = x["lead"], F.get("_found", i + 1)
        return (
            F.when(T.has(lead, K.PAY_DATE_LABEL), F.array(entry("pay_date", x["day"])))
            .when(T.has(lead, K.START_LABEL), F.array(entry("period_start", x["day"])))
            .when(T.has(lead, K.END_LABEL) & periodic, F.array(entry("period_end", x["day"])))
            .when(lead.contains("period") & nxt["lead"].rlike("(?U)^" + K.RANGE_DASH + "$"),
                  F.array(entry("period_start", x["day"]), entry("period_end", nxt["day"])))
            .otherwise(F.expr("cast(array() AS array<struct<role:string,day:date>>)")))

    return r.withColumn("dates", F.flatten(F.transform("_found", roles))).drop("_said", "_lead", "_all", "_found")


def first_role(role: str) -> Column:
    hit = F.get(F.filter("dates", lambda x: x["role"] == role), F.lit(0))["day"]
    return first(hit, hit.isNotNull())


def document_dates(rows: DataFrame) -> DataFrame:
    roles = ("pay_date", "period_start", "period_end")
    return with_dates(rows).groupBy("doc_id").agg(*[first_role(r).alias(r) for r in roles])


BOX = ("x0", "y0", "x1", "y1")


def placed(value: Column, box: str | None = None) -> Column:
    """A value with where it was read: its page and a box, that of its row unless another is named."""
    return F.struct(value.alias("value"), F.col("page"), *[F.col(f"{box}.{c}" if box else c).alias(c) for c in BOX])


def first_placed_role(role: str) -> Column:
    hit = F.get(F.filter("dates", lambda x: x["role"] == role), F.lit(0))["day"]
    return first(placed(hit), hit.isNotNull())


def stated_frequency() -> list[Column]:
    low = F.lower("text")
    possible = low.contains("week") | low.contains("month")  # cheap tests first: all of the patterns hold one of the words
    return [F.max(possible & T.has(low, pat)).alias(f"says_{name}") for name, pat in K.FREQUENCY_TEXT]


def chosen_frequency(start: Column, end: Column) -> tuple[Column, Column]:
    """(frequency, was it stated): the words in fixed order, else the period's length."""
    stated = F.coalesce(*[F.when(F.col(f"says_{n}"), F.lit(n)) for n, _ in K.FREQUENCY_TEXT])
    days = F.datediff(end, start) + 1
    inferred = (F.when(days.between(6, 8), "weekly").when(days == 14, "biweekly")
                .when(days.between(13, 16), "semimonthly").when(days.between(28, 31), "monthly"))
    return F.coalesce(stated, inferred), stated.isNotNull()


# --- pay stubs -------------------------------------------------------------

def segment_role(label: Column) -> Column:
    return (
        F.when(T.has(label, K.NET_LABEL), "net").when(T.has(label, K.TOTAL_LABEL), "total_deductions")
        .when(T.has(label, K.GROSS_LABEL), "gross").when(T.has(label, K.EARNING_LABEL), "earning")
        .when(T.has(label, K.DEDUCTION_LABEL), "deduction"))


def money_segments(rows: DataFrame) -> DataFrame:
    """Labelled segments with amounts, one row each, in reading order."""
    return segments_of(with_segments(rows))


def segments_of(facts: DataFrame) -> DataFrame:
    s = facts.select("doc_id", *WHERE, F.posexplode_outer("segs").alias("seg_no", "seg"))  # outer: no second evaluation to test for emptiness
    s = s.select("doc_id", *WHERE, "seg_no", "seg.label", "seg.vals").where((F.size("vals") > 0) & (F.col("label") != ""))
    return s.withColumn("role", segment_role(F.col("label")))


def money_spans(segments: DataFrame) -> DataFrame:
    """Every amount of a labelled segment with its font."""
    return placed_amounts(segments.select("doc_id", F.struct(*WHERE, "seg_no").alias("seq"), "vals"))


def placed_amounts(vals: DataFrame) -> DataFrame:
    """One row an amount, with its value, its page, and font, size and box as far as the rows' spans carry them."""
    known = vals.schema["vals"].dataType.elementType.names
    return vals.select("doc_id", "seq", F.posexplode("vals").alias("pos", "v")).select(
        "doc_id", "seq", "pos", "v.value", *[f"v.{c}" for c in STYLE if c in known], F.col("seq.page").alias("page"), *[f"v.{c}" for c in BOX if c in known])


def line_values() -> Column:
    """(rate, hours, current, ytd, may_swap) of a segment by its role and number of amounts."""
    v = lambda i: F.get("vals", F.lit(i))
    n, value = F.size("vals"), lambda i: v(i)["value"]
    none = F.get("vals", F.lit(10**6))
    pack = lambda r, h, c, y, swap: F.struct(r.alias("rate"), h.alias("hours"), c.alias("current"), y.alias("ytd"), F.lit(swap).alias("may_swap"))
    from_end = lambda back: F.get("vals", n - back)
    product = F.abs(value(0) * value(1) - value(2)) <= K.RATE_TOLERANCE
    small = (F.least(value(0), value(1)) <= 400) & (F.greatest(value(0), value(1)) <= 2000)
    earning = (
        F.when((n >= 3) & product, pack(v(0), v(1), v(2), v(3), False))
        .when((n >= 4) & small, pack(v(0), v(1), v(2), v(3), False))
        .when(n >= 3, pack(none, none, from_end(2), from_end(1), True)))
    pair = F.when(n >= 2, pack(none, none, v(0), v(1), True)).otherwise(pack(none, none, v(0), none, False))
    return F.when((F.col("role") == "earning") & (n >= 3), earning).when(
        (F.col("role") == "gross") & (n > 2), pack(none, none, from_end(2), from_end(1), True)).otherwise(pair)


def ytd_first(rows: DataFrame) -> Column:
    """Aggregate: does the first header naming both columns print year-to-date before current?"""
    low = F.lower("text")
    both = low.contains("current") & T.has(low, K.YTD_HEADER)
    ytd_at = F.length(F.element_at(F.split(low, K.YTD_HEADER, 2), 1))
    return F.coalesce(first(ytd_at < F.instr(low, "current") - 1, both), F.lit(False))


def header_row_facts(rows: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """What single rows of a stub say about its header: dates and names with their boxes."""
    text = F.col("text")
    r = with_name(with_dates(rows), "emp", T.has(text, K.EMPLOYEE_ROW, True), K.EMPLOYEE_LABEL)
    r = with_name(r, "org", T.has(text, K.EMPLOYER_ROW, True), K.EMPLOYER_LABEL)
    return r.select("doc_id", *WHERE, "text", *BOX, "dates", "emp", "emp_box", "org", "org_box", *more)


def stub_row_facts(rows: DataFrame) -> DataFrame:
    """All that single rows of a stub say, in one narrow pass: dates, names with their boxes, segments with their amounts."""
    return header_row_facts(with_segments(rows), ["segs"])


HEADER_VALUES = ("employee", "employer", "pay_date", "period_start", "period_end")


def placed_headers(facts: DataFrame) -> DataFrame:
    """Per document, from `stub_row_facts`, in one aggregate: names and dates with their places (``<name>_at``), frequency, column order."""
    d = facts.groupBy("doc_id").agg(
        first(placed(F.col("emp"), "emp_box"), F.col("emp").isNotNull()).alias("employee_at"),
        first(placed(F.col("org"), "org_box"), F.col("org").isNotNull()).alias("employer_at"),
        *[first_placed_role(x).alias(f"{x}_at") for x in ("pay_date", "period_start", "period_end")],
        *stated_frequency(), ytd_first(facts).alias("ytd_first"))
    freq, stated = chosen_frequency(F.col("period_start_at.value"), F.col("period_end_at.value"))
    return d.withColumn("frequency", freq).withColumn("frequency_stated", stated).drop(*[f"says_{n}" for n, _ in K.FREQUENCY_TEXT])


def stub_headers(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per document: names, dates, frequency words and column order."""
    d = placed_headers(header_row_facts(rows) if facts is None else facts)
    return d.select("doc_id", *[F.col(f"{c}_at.value").alias(c) for c in HEADER_VALUES], "ytd_first", "frequency", "frequency_stated")


def letterhead(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Employer by layout: the largest lettered text in the top 30 % of page one, and its place. One shuffle by document."""
    p1 = pages.where(F.col("page") == 1).select("doc_id", (F.col("height") * 0.3).alias("_limit"))
    top = (spans.where((F.col("page") == 1) & F.col("text").rlike("[A-Za-z]{3}") & ~T.has(F.col("text"), K.NOT_A_LETTERHEAD, True))
           .join(p1, "doc_id").where(F.col("y0") < F.col("_limit"))
           .select("doc_id", "text", *BOX, F.coalesce("size", F.lit(0.0)).alias("size"), "span_no"))
    mine = Window.partitionBy("doc_id")
    large = top.withColumn("_big", F.max("size").over(mine)).where(F.col("size") >= F.col("_big") * 0.92)
    at = F.struct(F.bround(F.col("y0") / 4, 0), "x0", "span_no")
    same = large.withColumn("_y", F.min_by("y0", at).over(mine)).where(F.abs(F.col("y0") - F.col("_y")) < 4)
    line = same.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x0", "span_no", "text", "y0", "x1", "y1"))).alias("w"))
    left, right = F.element_at("w", 1), F.element_at("w", -1)
    return line.select("doc_id", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("employer"),
                       left["x0"].alias("x0"), left["y0"].alias("y0"), right["x1"].alias("x1"), right["y1"].alias("y1"))


def full_headers(headers: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """`placed_headers` with the letterhead as employer where no label names one."""
    missing = never_broadcast(headers.where(F.col("employer_at").isNull()).select("doc_id"))
    printed = letterhead(spans.join(missing, "doc_id", "left_semi"), pages)
    page = headers.schema["employer_at"].dataType["page"].dataType
    found = printed.select("doc_id", F.struct(F.col("employer").alias("value"), F.lit(1).cast(page).alias("page"), *BOX).alias("_letterhead"))
    return headers.join(found, "doc_id", "left").withColumn("employer_at", F.coalesce("employer_at", "_letterhead")).drop("_letterhead")


def stub_lines(segments: DataFrame, headers: DataFrame) -> DataFrame:
    """Pay lines of all roles with column order applied."""
    s = segments.where(F.col("role").isNotNull()).withColumn("v", line_values())
    s = s.join(never_broadcast(headers.select("doc_id", "ytd_first")), "doc_id", "left")
    swap = F.col("v.may_swap") & F.coalesce("ytd_first", F.lit(False))
    return s.select(
        "doc_id", F.struct(*WHERE, "seg_no").alias("line_at"), "role", "label",
        F.when(swap, F.col("v.ytd")).otherwise(F.col("v.current")).alias("c"),
        F.when(swap, F.col("v.current")).otherwise(F.col("v.ytd")).alias("y"),
        F.col("v.rate.value").alias("rate"), F.col("v.hours.value").alias("hours"), F.col("v.rate").alias("rate_at"), F.col("v.hours").alias("hours_at"))


def line_number(at: Column) -> Column:
    """(page, height, segment) as one number that sorts the same; rows lie at least half a point apart."""
    return (at["page"].cast("bigint") * 10**13 + F.floor(at["at"]["y"] * 1000).cast("bigint") * 1000 + at["seg_no"]).cast("bigint")


def stub_amounts(lines: DataFrame) -> DataFrame:
    """Gross, net and total deductions: the first line of each role."""
    pick = lambda role: F.min_by(F.struct(F.col("c.value").alias("c"), F.col("y.value").alias("y")), F.when(F.col("role") == role, F.col("line_at")))
    d = lines.where(F.col("role").isin("gross", "net", "total_deductions")).groupBy("doc_id").agg(
        pick("gross").alias("g"), pick("net").alias("n"), pick("total_deductions").alias("t"))
    return d.select("doc_id", F.col("g.c").alias("gross"), F.col("g.y").alias("gross_ytd"), F.col("n.c").alias("net"),
                    F.col("n.y").alias("net_ytd"), F.col("t.c").alias("total_deductions"))


def printed_lines(lines: DataFrame) -> DataFrame:
    """Lines of all five roles with their number, type sizes and the boxes of both amounts. Gross, net and total are those read first."""
    single = F.col("role").isin("gross", "net", "total_deductions")
    first_of = lines.where(single).groupBy("doc_id", "role").agg(F.min("line_at").alias("_first"))
    chosen = lines.join(first_of, ["doc_id", "role"], "left").where(~single | (F.col("line_at") == F.col("_first")))
    box = lambda v: F.when(v.isNotNull(), F.struct(*[v[c].alias(c) for c in BOX]))
    return chosen.select(
        "doc_id", line_number(F.col("line_at")).alias("line_no"), F.when(F.col("role") == "total_deductions", "total").otherwise(F.col("role")).alias("kind"), "label",
        F.col("c.value").alias("current"), F.col("y.value").alias("ytd"), "rate", "hours", F.col("c.x1").alias("x1"), F.col("c.size").alias("size"),
        F.col("y.size").alias("ytd_size"), F.col("line_at.page").alias("page"), box(F.col("c")).alias("box"), box(F.col("y")).alias("ytd_box"),
        box(F.col("rate_at")).alias("rate_box"), box(F.col("hours_at")).alias("hours_box"))


def extract_stubs(rows: DataFrame, spans: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paystubs, paystub_lines) of documents already known to be pay stubs. Lines have all five roles."""
    x = extract_stub_tables(rows, spans, pages)
    return x["stubs"], x["lines"]


def extract_stub_tables(rows: DataFrame, spans: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """stubs, lines, boxes (see `stub_boxes`) and money (see `money_spans`) of pay stubs.

    Rows are read once: what they say is a stage, so are the headers (one row a document) and the lines, and all tables come from those.
    """
    facts = staged(stub_row_facts(rows), "stub-rows")
    headers = staged(full_headers(placed_headers(facts), spans, pages), "stub-headers")
    segments = segments_of(facts)
    lines = staged(stub_lines(segments, headers), "stub-lines")
    stubs = headers.select("doc_id", *[F.col(f"{c}_at.value").alias(c) for c in HEADER_VALUES], "frequency", "frequency_stated").join(stub_amounts(lines), "doc_id", "left")
    out = printed_lines(lines)
    return {"stubs": stubs, "lines": out, "boxes": stub_boxes(headers, out), "money": money_spans(segments)}


def stub_boxes(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, line_no, page, x0 .. y1): where each value of a stub stands.

    Fields of headers by name; gross, net and total_deductions and their year to date; and for each line, by its number, its amount as
    earning or deduction, ytd, rate and hours. The first tax lines are named as well, and the first line that shrank (`shrunk`).
    """
    none = F.lit(None).cast("bigint")
    entry = lambda field, at, no=none, page=None: F.struct(F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"), no.alias("line_no"),
                                                           (at["page"] if page is None else page).alias("page"), *[at[c].alias(c) for c in BOX])
    known = lambda *entries: F.inline(F.filter(F.array(*entries), lambda e: e["x0"].isNotNull()))
    top = headers.select("doc_id", known(*[entry(c, F.col(f"{c}_at")) for c in HEADER_VALUES]))
    name, page, no = F.when(F.col("kind") == "total", "total_deductions").otherwise(F.col("kind")), F.col("page"), F.col("line_no")
    each = lines.select("doc_id", known(entry(name, F.col("box"), no, page), entry(F.concat(name, F.lit("_ytd")), F.col("ytd_box"), no, page),
                                        entry("rate", F.col("rate_box"), no, page), entry("hours", F.col("hours_box"), no, page)))
    tax = (F.col("kind") == "deduction") & F.col("current").isNotNull()
    order = F.struct(lookup(K.SHRUNK_ORDER, F.col("kind")).alias("kind"), "line_no")
    shrank = F.col("current").isNotNull() & (F.col("ytd") + K.CENT_TOLERANCE < F.col("current"))
    best = lambda cond, by, *boxes: F.min_by(F.struct("page", "line_no", *boxes), F.when(cond, by))
    firsts = lines.groupBy("doc_id").agg(
        best(tax & T.has(F.col("label"), K.SOCIAL_SECURITY_LABEL), no, "box").alias("ss"), best(tax & T.has(F.col("label"), K.MEDICARE_LABEL), no, "box").alias("med"),
        best(shrank, order, "box", "ytd_box").alias("shrunk"))
    named = firsts.select("doc_id", known(*[entry(field, F.col(f"{c}.{box}"), F.col(f"{c}.line_no"), F.col(f"{c}.page")) for field, c, box in (
        ("social_security", "ss", "box"), ("medicare", "med", "box"), ("shrunk", "shrunk", "box"), ("shrunk_ytd", "shrunk", "ytd_box"))]))
    return top.unionByName(each).unionByName(named)


# --- bank statements -------------------------------------------------------

def bank_row_facts(rows: DataFrame) -> DataFrame:
    """All that single rows of a statement say, in one narrow pass: amounts, kind of row, parts of a date, year, holder."""
    r = with_name(with_amounts(rows), "holder", T.has(F.col("text"), K.HOLDER_ROW, True), K.HOLDER_LABEL).drop("spans")
    low, anchored = F.lower("text"), "(?U)^" + K.TXN_LINE
    dated = F.col("text").rlike(r"^\s*\p{Nd}")  # cheap test first
    g = lambda i: F.when(dated, F.regexp_extract("text", anchored, i)).otherwise("")
    txn = dated & (F.size("vals") >= 2) & F.col("text").rlike(anchored) & ~T.has(low, K.CARRIED_FORWARD)
    dep, wd = T.has(low, K.DEPOSIT_TOTAL_LABEL), T.has(low, K.WITHDRAWAL_TOTAL_LABEL)
    role = (F.when(txn, "txn").when(T.has(low, K.BEGIN_LABEL), "begin").when(T.has(low, K.CLOSE_LABEL), "end")
            .when(dep & wd, "both").when(dep, "deposits").when(wd, "withdrawals"))
    said = F.when(F.col("text").rlike(r"\p{Nd}"), F.year(T.mention_to_date(F.get(T.date_strings(F.col("text")), F.lit(0)))))
    last = lambda back: F.when(F.size("vals") >= back, F.element_at("vals", -back))
    return r.select("doc_id", *WHERE, "text", F.when(F.size("vals") > 0, role).alias("role"), g(1).alias("mm"), g(2).alias("dd"), g(3).alias("yy"), g(4).alias("tail"),
                    last(1).alias("last"), last(2).alias("before"), "vals", said.alias("said_year"), "holder", "holder_box")


def bank_rows(rows: DataFrame) -> DataFrame:
    """Rows with amounts, marked as transaction line or summary line."""
    return marked_rows(bank_row_facts(rows))


def marked_rows(facts: DataFrame) -> DataFrame:
    return facts.where(F.size("vals") > 0).select("doc_id", *WHERE, "text", "role", "mm", "dd", "yy", "tail", F.col("last.value").alias("last_value"), F.col("before.value").alias("amount"))


def statement_year(rows: DataFrame, today: str) -> DataFrame:
    """Year of the first row that opens with a valid date, else the year of ``today``."""
    head = T.mention_to_date(F.get(T.date_strings(F.col("text")), F.lit(0)))
    return year_of(rows.select("doc_id", *WHERE, F.year(head).alias("said_year")), today)


def year_of(facts: DataFrame, today: str) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.coalesce(first(F.col("said_year"), F.col("said_year").isNotNull()), F.year(F.lit(today).cast("date"))).alias("year"))


def bank_lines(marked: DataFrame, years: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    t = marked.where(F.col("role") == "txn").join(years, "doc_id", "left")
    y = F.when(F.col("yy") != "", F.col("yy").cast("int")).otherwise(F.col("year"))
    y = F.when(y < 100, y + 2000).otherwise(y)
    day = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad("mm", 2, "0"), F.lpad("dd", 2, "0")).try_cast("date")
    desc = T.strip(F.regexp_replace("tail", T.MONEY, ""), " -$")
    return t.select("doc_id", F.struct(*WHERE).alias("line_at"), day.alias("date"), desc.alias("desc"), "amount",
                    F.col("last_value").alias("balance"), *more).where(F.col("date").isNotNull())


def extract_statements(rows: DataFrame, today: str) -> dict[str, DataFrame]:
    """statements, txns (numbered without gaps from 0), boxes and money of documents already known to be bank statements.

    Rows are read once, as for stubs. A statement's text is one value, as the rule that looks for the applicant in it needs it.
    """
    facts = staged(bank_row_facts(rows), "bank-rows")
    marked = facts.where(F.size("vals") > 0).withColumns({"last_value": F.col("last.value"), "amount": F.col("before.value")})
    lines = bank_lines(marked, year_of(facts, today), ["last", "before"])
    lines = lines.withColumn("_no", line_number(F.struct(F.col("line_at.page").alias("page"), F.col("line_at.at").alias("at"), F.lit(0).alias("seg_no"))))
    lines = with_rank(staged(lines, "bank-lines"), ["doc_id"], "_no", "txn_no").withColumn("txn_no", (F.col("txn_no") - 1).cast("bigint")).drop("_no")
    head = top_k(facts.select("doc_id", *WHERE, "holder", "holder_box"), ["doc_id"], [F.col("page"), F.col("at")], K.HOLDER_ROWS)
    named = head.groupBy("doc_id").agg(first(placed(F.col("holder"), "holder_box"), F.col("holder").isNotNull()).alias("holder_at"))
    sums = placed_summary(marked)
    texts = document_text(facts)
    statements = texts.join(named, "doc_id", "left").join(sums, "doc_id", "left")
    none = F.lit(None).cast("bigint")
    entry = lambda field, at, no=none, page=None: F.struct(F.lit(field).alias("field"), no.alias("line_no"), (at["page"] if page is None else page).alias("page"), *[at[c].alias(c) for c in BOX])
    known = lambda *entries: F.inline(F.filter(F.array(*entries), lambda e: e["x0"].isNotNull()))
    top = statements.select("doc_id", known(entry("employee", F.col("holder_at")), *[entry(c, F.col(f"{c}_at")) for c in SUMMARY]))
    each = lines.select("doc_id", known(entry("amount", F.col("before"), F.col("txn_no"), F.col("line_at.page")), entry("balance", F.col("last"), F.col("txn_no"), F.col("line_at.page"))))
    return {"statements": statements.select("doc_id", "text", F.col("holder_at.value").alias("holder"), *[F.col(f"{c}_at.value").alias(c) for c in SUMMARY]),
            "txns": lines.select("doc_id", "txn_no", "date", "desc", "amount", "balance"), "boxes": top.unionByName(each), "money": bank_money(facts)}


def bank_money(facts: DataFrame) -> DataFrame:
    """Every amount of a statement's rows with its font and place, from `bank_row_facts`."""
    return placed_amounts(facts.select("doc_id", F.struct(*WHERE, F.lit(0).alias("seg_no")).alias("seq"), "vals"))


SUMMARY = ("begin_balance", "end_balance", "total_deposits", "total_withdrawals")


def placed_summary(marked: DataFrame) -> DataFrame:
    """The four summary amounts with their places (``<name>_at``); the first row of each kind wins.

    A row naming both totals counts as deposits if it is the first deposit row, else as withdrawals: so withdrawals are the first of the
    withdrawal rows and of the rows naming both, without the one that gave the deposits.
    """
    role, box = F.col("role"), F.struct(F.col("last.value").alias("value"), F.col("page"), *[F.col(f"last.{c}").alias(c) for c in BOX])
    here = F.struct(*WHERE)
    of = lambda *roles: F.when(role.isin(*roles), here)
    s = marked.where(role.isin("begin", "end", "deposits", "withdrawals", "both"))
    # of rows that name both, only the first two can matter: the first may give the deposits, then the second may give the withdrawals
    both = top_k(s.where(role == "both").select("doc_id", *WHERE, box.alias("v")), ["doc_id"], [F.col("page"), F.col("at")], 2)
    both = both.groupBy("doc_id").agg(F.min_by("v", F.when(F.col("rank") == 1, here)).alias("b1"), F.min(F.when(F.col("rank") == 1, here)).alias("b1_where"),
                                      F.min_by("v", F.when(F.col("rank") == 2, here)).alias("b2"), F.min(F.when(F.col("rank") == 2, here)).alias("b2_where"))
    d = s.groupBy("doc_id").agg(
        F.min_by(box, of("begin")).alias("begin_balance_at"), F.min_by(box, of("end")).alias("end_balance_at"),
        F.min_by(box, of("deposits")).alias("_dep"), F.min(of("deposits")).alias("_dep_where"),
        F.min_by(box, of("withdrawals")).alias("_wd"), F.min(of("withdrawals")).alias("_wd_where")).join(both, "doc_id", "left")
    taken = F.col("b1_where").isNotNull() & (F.col("_dep_where").isNull() | (F.col("b1_where") < F.col("_dep_where")))
    other, other_where = F.when(taken, F.col("b2")).otherwise(F.col("b1")), F.when(taken, F.col("b2_where")).otherwise(F.col("b1_where"))
    withdrawals = F.when(F.col("_wd_where").isNull() | (other_where < F.col("_wd_where")), F.coalesce(other, F.col("_wd"))).otherwise(F.col("_wd"))
    return d.select("doc_id", "begin_balance_at", "end_balance_at", F.when(taken, F.col("b1")).otherwise(F.col("_dep")).alias("total_deposits_at"), withdrawals.alias("total_withdrawals_at"))


def bank_summary(rows: DataFrame) -> DataFrame:
    """Begin and end balance, deposit and withdrawal totals, from rows or their facts; the first row of each kind wins."""
    facts = rows if "vals" in rows.columns else bank_row_facts(rows)
    d = placed_summary(facts.where(F.size("vals") > 0))
    return d.select("doc_id", *[F.col(f"{c}_at.value").alias(c) for c in SUMMARY])


def account_holder(rows: DataFrame) -> DataFrame:
    """Holder named in the first 14 rows."""
    head = top_k(rows.select("doc_id", *WHERE, "text", "spans"), ["doc_id"], [F.col("page"), F.col("at")], K.HOLDER_ROWS)
    h = with_name(head, "holder", T.has(F.col("text"), K.HOLDER_ROW, True), K.HOLDER_LABEL).where(F.col("holder").isNotNull())
    return h.groupBy("doc_id").agg(first(F.col("holder")).alias("holder"))


def report_fields(stubs: DataFrame) -> DataFrame:
    """Fields as the JSON text a stored report carries."""
    cols = [c for c in stubs.columns if c != "doc_id"]
    return stubs.select("doc_id", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])).alias("fields"))
