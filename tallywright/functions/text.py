"""Column expressions over text: money, dates, names, fonts, software names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright import constants as K

# Spark's regex classes are ASCII unless (?U) is given; the fixed patterns mean Unicode.
MONEY = "(?U)" + K.MONEY
DATE = "(?iU)" + K.DATE


def has(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    unicode = "U" if ignore_case or "\\" in pattern else ""  # plain letters need no Unicode classes
    flags = ("i" if ignore_case else "") + unicode
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text holds any of the literal words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def money_strings(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(MONEY), F.lit(1))
    return F.when(text.contains("."), found).otherwise(F.expr("cast(array() AS array<string>)"))  # cheap test first


def to_money(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def money_mentions(text: Column) -> Column:
    """Every amount in reading order; signs and brackets are not kept."""
    return F.transform(money_strings(text), to_money)


def text_before_money(text: Column) -> Column:
    return F.when(text.contains("."), F.element_at(F.split(text, MONEY, 2), 1)).otherwise(text)


def date_strings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(0))


def texts_before_dates(text: Column) -> Column:
    """For the n-th date mention, the text between it and the mention before."""
    return F.split(text, DATE, -1)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def mention_to_date(mention: Column) -> Column:
    """One date mention to a date; impossible dates become null."""
    part = lambda i: F.regexp_extract(mention, DATE, i)
    slash_year = F.when(part(3).cast("int") < 100, (part(3).cast("int") + 2000).cast("string")).otherwise(part(3))
    month = F.array_position(F.array(*[F.lit(x) for x in K.MONTH_NAMES]), F.lower(F.substring(part(7), 1, 3)))
    return (
        F.when(part(1) != "", _ymd(slash_year, part(1), part(2)))
        .when(part(4) != "", _ymd(part(4), part(5), part(6)))
        .when(part(7) != "", _ymd(part(9), month.cast("string"), part(8)))
    )


def date_mentions(text: Column) -> Column:
    """Valid dates in reading order."""
    return F.filter(F.transform(date_strings(text), mention_to_date), lambda d: d.isNotNull())


def name_tokens(text: Column) -> Column:
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]", " ")
    return F.filter(F.array_distinct(F.split(letters, " +")), lambda t: F.length(t) > 1)


def names_match(a: Column, b: Column) -> Column:
    """True / false, or null when either side has no usable word."""
    ta, tb = name_tokens(a), name_tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), shared >= F.least(F.lit(2), F.size(ta), F.size(tb)))


def tokens_within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(name_tokens(a), name_tokens(b))) == 0


def base_family(font: Column) -> Column:
    """Typeface name without subset tag, style words and foundry suffix."""
    name = F.element_at(F.split(font, r"\+"), -1)
    name = F.regexp_replace(name, K.FONT_STYLE_TAIL, "")
    name = F.regexp_replace(name, K.FONT_STYLE_SUFFIX, "")
    name = F.regexp_replace(name, K.FONT_FOUNDRY_TAIL, "")
    return F.when(F.coalesce(font, F.lit("")) == "", F.lit("")).otherwise(F.lower(strip(name, "-, ")))


def pdf_timestamp(text: Column) -> Column:
    """``D:YYYYMMDD[HH[MM[SS]]]`` to a timestamp without zone; anything else is null."""
    part = lambda i: F.regexp_extract(text, K.PDF_TIMESTAMP, i)
    digits = F.concat(part(1), part(2), part(3), *[F.rpad(part(i), 2, "0") for i in (4, 5, 6)])
    stamp = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return F.when(part(1) != "", stamp)


def usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMM dd, yyyy")


def elapsed_words(seconds: Column) -> Column:
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 3600, F.concat(whole(60), F.lit(" minutes")))
        .when(seconds < 172800, F.concat(whole(3600), F.lit(" hours")))
        .otherwise(F.concat(whole(86400), F.lit(" days")))
    )


def description_kind(desc: Column) -> Column:
    """Deposit or withdrawal from the words of a bank line."""
    return F.when(has(desc, K.DEPOSIT_DESCRIPTION, True), "deposit").otherwise("withdrawal")


def lookup(values: dict, key: Column, default=None) -> Column:
    """A fixed dictionary as a CASE expression."""
    items = list(values.items())
    expr = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(key == F.lit(k), F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))
