"""The finding record, how rules emit it, and the catalogue of its fixed wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions.text import lookup

FIELDS = [
    ("code", "string"), ("variant", "string"), ("category", "string"), ("severity", "string"),
    ("emit", "int"), ("sub", "bigint"), ("page", "int"), ("what", "string"), ("fix_detail", "string"),
    ("ask", "string"), ("rel", "double"), ("implied_gross", "double"), ("n", "bigint"), ("detail", "array<string>"),
]

ASKS = {
    "original": "Please send the PDF exactly as downloaded from the payroll or bank website, not a scan, "
                "photo, screenshot or edited copy.",
    "clear": "Please send a sharper copy: full page, flat, focused and evenly lit.",
    "connect": "If the original file is unavailable, ask the leasing office how your employer or bank can "
               "confirm the income directly.",
    "recent": "Please send your newest pay stubs, dated within 60 days.",
    "name": "Please send documents in your legal name as given on the application.",
    "full": "Please send the whole document with all its pages and its totals.",
    "consecutive": "Please send your two latest consecutive pay stubs.",
    "type": "Please send a pay stub or a bank statement.",
    "unlocked": "Please send an unlocked PDF or a clear photo.",
    "periods": "Please send stubs from different pay periods.",
    "account": "Please send the statement of the account your wages are paid into.",
}

# (code, variant): title, why it matters, what would settle it
CATALOG = {
    ("F_EDITOR", "image"): ("Saved by image-editing software", "Payroll and bank systems write their own files; an image editor means a person re-saved it.", "The untouched export whose metadata names the provider's generator."),
    ("F_EDITOR", "pdf"): ("Saved by PDF-editing software", "Payroll and bank systems write their own files; a PDF editor means a person re-saved it.", "The untouched export whose metadata names the provider's generator."),
    ("F_EDITOR", "exif"): ("Image saved by editing software", "Cameras and scanners name themselves; an editor's name means the picture was re-saved in it.", "The provider's PDF or a photo straight from the device."),
    ("F_OFFICE", ""): ("Made in an office program", "Large providers do not issue statements from office software; small employers may, so it needs support.", "Independent confirmation of the income."),
    ("F_MODIFIED", ""): ("Changed after creation", "Provider exports are written once; a later time means a re-save.", "A fresh download whose times agree."),
    ("F_NOMETA", ""): ("Metadata removed", "Providers identify their software; nothing is left after a converter or scrubber.", "The provider's own export."),
    ("F_INCREMENTAL", ""): ("Later revisions appended", "Editors append changes to a file; a generated statement has one revision.", "The single-revision export."),
    ("F_ANNOT", ""): ("Objects placed over the page", "Annotations are added by hand and can hide figures.", "A copy without annotations."),
    ("F_TEXT_ON_SCAN", ""): ("Typed text over a scan", "A scan is one picture; live text over it was added later.", "The digital original or an unaltered scan."),
    ("F_STACKED", ""): ("Two texts lie on one spot", "Covered text stays in the file under the text that replaced it.", "A statement where each figure exists once."),
    ("F_PATCH", ""): ("Blank rectangles under text", "A lone blank box under a figure is how a value is whited out.", "The export without cover-up shapes."),
    ("F_FONT", ""): ("More than one typeface for amounts", "Payroll software prints every amount in one font.", "A statement with one typeface for amounts."),
    ("F_ALIGN", ""): ("An amount stands off the common edge", "Generated columns share one right edge.", "A statement with aligned amounts."),
    ("F_SIZE", ""): ("Unequal print sizes in a line", "Amounts on a line are printed together at one size.", "A statement with one size per line."),
    ("F_SCAN", "image"): ("A picture, not the original file", "A picture keeps none of the structure that lets a file be authenticated.", "The provider's PDF."),
    ("F_SCAN", "pdf"): ("A scan inside a PDF", "A picture keeps none of the structure that lets a file be authenticated.", "The provider's PDF."),
    ("F_PIXEL", ""): ("Areas to look at in the image", "Edited spots keep another texture than the page around them; experimental, no effect on the result.", "The provider's PDF."),
    ("C_UNREADABLE", "kind"): ("The file could not be opened", "Nothing in it can be checked.", "A PDF or image that opens without a password."),
    ("C_UNREADABLE", "words"): ("Too few words to go by", "The copy is too poor to check.", "A sharp, complete copy."),
    ("C_MISSING", "stub"): ("Facts that identify the stub are absent", "The stub cannot be tied to a person, employer and period without it.", "A complete pay stub."),
    ("C_MISSING", "bank"): ("No balances or transactions found", "The statement cannot be reconciled.", "The full statement."),
    ("C_NET_MATH", ""): ("Net does not follow from gross", "Payroll software computes net, so the three always agree.", "A stub that balances."),
    ("C_DED_SUM", ""): ("Deduction lines and their total differ", "The total is the sum of its lines.", "A stub whose lines add up."),
    ("C_EARN_SUM", ""): ("Earnings lines and gross differ", "Gross is the sum of the earnings lines.", "A stub whose lines add up."),
    ("C_RATE_HOURS", ""): ("An hourly line does not multiply out", "The payroll system multiplies; a line that fails was typed.", "A stub whose line multiplies out."),
    ("C_FICA_SS", ""): ("Social Security does not fit the gross", "The rate is fixed by law, so the line reveals the real wages.", "A stub at 6.20% of taxable wages."),
    ("C_FICA_MED", ""): ("Medicare does not fit the gross", "The rate is fixed by law, so the line reveals the real wages.", "A stub at 1.45% of taxable wages."),
    ("C_YTD_LT", ""): ("The yearly sum is smaller than the period's", "Year to date includes this period.", "A stub with year-to-date at least the current amount."),
    ("C_YTD_PACE", ""): ("Year to date is too high for the date", "It grows by one paycheck per period.", "Earlier stubs of the year or employer confirmation."),
    ("C_DATES", "length"): ("The period runs backwards", "No payroll system prints a negative period.", "A stub with a valid period."),
    ("C_DATES", "early"): ("Paid before the period begins", "Wages are paid during or after their period.", "A stub paid on or after its period."),
    ("C_FUTURE", ""): ("Pay date lies ahead", "A stub is issued when wages are paid.", "A stub already paid."),
    ("C_STALE", ""): ("Stub older than 90 days", "Old stubs show past income.", "Stubs of the last 60 days."),
    ("C_PERIOD", ""): ("Period length does not fit the frequency", "Length follows from frequency.", "A stub whose period fits."),
    ("C_PREDATED", ""): ("File made well before the pay date", "Payroll runs a few days ahead at most.", "A stub from that payroll run."),
    ("C_ROUND", ""): ("Only whole-dollar amounts", "Percentage taxes rarely end in .00.", "A second source such as deposits."),
    ("C_NAME", "stub"): ("Stub is for another person", "Income counts only for its earner.", "Documents of the applicant or proof of a name change."),
    ("C_NAME", "bank"): ("Applicant is not on the statement", "Deposits count only for the account's owner.", "A statement in the applicant's name."),
    ("C_TYPE", ""): ("Not a pay stub or bank statement", "Only those two can be reconciled.", "A pay stub or a bank statement."),
    ("B_RUNNING", ""): ("A balance does not follow from its line", "Each balance is the one before plus or minus its line.", "The bank's own download."),
    ("B_ENDING", ""): ("Last balance is not the ending balance", "The summary is derived from the lines.", "The complete statement."),
    ("B_SUMMARY", ""): ("Summary does not balance", "It is the accounting identity of a statement.", "A statement whose summary balances."),
    ("B_DEPOSITS", ""): ("Deposits do not reach their total", "An inflated line breaks the total.", "The unaltered statement."),
    ("X_DUP", ""): ("An upload repeats another", "A copy adds no evidence.", "A different period per stub."),
    ("X_SAME_PERIOD", ""): ("One pay date, two different nets", "An employer issues one stub per pay date.", "The one stub issued for that date."),
    ("X_YTD", "step"): ("Year to date does not step by the gross", "On consecutive stubs it rises by exactly the gross.", "Consecutive stubs that agree."),
    ("X_YTD", "gap"): ("Year to date rose by less than one paycheck", "It grows by at least each period's pay.", "Consistent consecutive stubs."),
    ("X_DEPOSIT_OK", ""): ("A deposit equals the net pay", "An independent document supports the stub.", "Nothing needed."),
    ("X_DEPOSIT", ""): ("No deposit equals the net pay", "Direct deposits appear in the account.", "The statement of the account paid, or payroll verification."),
}


def finding(code: str, severity, emit: int, what: Column, *, category="file", variant="", sub=None, page=None,
            fix=None, ask=None, rel=None, implied=None, n=None, detail=None) -> Column:
    """A lean finding struct; fixed wording is joined later by :func:`describe`."""
    values = {
        "code": F.lit(code), "variant": variant if isinstance(variant, Column) else F.lit(variant),
        "category": F.lit(category), "severity": severity if isinstance(severity, Column) else F.lit(severity),
        "emit": F.lit(emit), "sub": F.lit(0) if sub is None else sub, "page": page, "what": what,
        "fix_detail": fix, "ask": ask if isinstance(ask, Column) else F.lit(ask), "rel": rel,
        "implied_gross": implied, "n": n, "detail": detail,
    }
    return F.struct(*[(F.lit(None) if values[f] is None else values[f]).cast(t).alias(f) for f, t in FIELDS])


def emit(df: DataFrame, keys: list[str], *rules: tuple[Column, Column]) -> DataFrame:
    """Evaluate all (condition, finding) rules of a row in one projection."""
    found = F.array(*[F.when(cond, rec) for cond, rec in rules])
    # Outer, then filtered: a plain inline makes the optimizer evaluate all rules twice to test for emptiness.
    # The array is a column of its own so that it is compiled; inside the generator it would be interpreted.
    return df.select(*keys, found.alias("_found")).select(*keys, F.inline_outer("_found")).where(F.col("code").isNotNull())


def soften(severity: str, ocr_used: Column) -> Column:
    """Critical and high count as medium when the text came from OCR."""
    return F.when(ocr_used, F.lit("medium")).otherwise(F.lit(severity)) if severity in ("critical", "high") else F.lit(severity)


def severity_rank(severity: Column) -> Column:
    return lookup(K.SEVERITY_ORDER, severity)


def catalog(spark) -> DataFrame:
    rows = [(c, v, *texts) for (c, v), texts in CATALOG.items()]
    return spark.createDataFrame(rows, "code string, variant string, title string, why string, fix string")


def describe(findings: DataFrame) -> DataFrame:
    """Add title, why, fix and the applicant's request. The catalogue is a fixed list of about 50 rows."""
    texts = F.broadcast(catalog(findings.sparkSession))
    out = findings.join(texts, ["code", "variant"], "left")
    return out.withColumn("fix", F.coalesce("fix_detail", "fix")).withColumn(
        "applicant_request", lookup(ASKS, F.col("ask"))
    ).drop("fix_detail", "ask")
