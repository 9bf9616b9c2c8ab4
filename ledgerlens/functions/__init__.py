"""Scalar column functions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MONEY

MICROS_PER_DAY = 86_400_000_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1 / P2: coercion ------------------------------------------------------

# Text date layouts accepted after ISO-8601, month first for ambiguous
# dates (as the source's parser reads "01/02/2020" as 2 January).
DATE_PATTERNS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy"]


def to_timestamp_or_null(c: str | Column) -> Column:
    """Unparseable text -> null (``try_to_timestamp``; plain cast raises under ANSI).

    ISO-8601 first, then the US-style layouts above; the first that parses wins.
    """
    text = F.trim(col_(c).cast("string"))
    return F.coalesce(F.try_to_timestamp(text),
                      *[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def to_money(c: str | Column, kind: T.DataType | None = None) -> Column:
    """Text or number -> decimal(30,6); unparseable, non-finite or null -> 0.

    A number too large for the type raises instead of reading as 0. With the column's type
    given, numbers are converted directly, not by way of text.
    """
    c, zero = col_(c), F.lit(0).cast(MONEY)
    if isinstance(kind, (T.DecimalType, T.IntegralType)):
        return F.coalesce(c.cast(MONEY), zero)  # ANSI: overflow raises
    if isinstance(kind, T.FractionalType):
        number = c.cast("double")
        finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
        return F.when(finite, c.cast(MONEY)).otherwise(zero)
    text = F.trim(c.cast("string"))
    exact, number = text.try_cast(MONEY), text.try_cast("double")
    not_a_number = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    too_large = F.raise_error(F.concat(F.lit("amount does not fit decimal(30,6): "), text)).cast(MONEY)
    return F.coalesce(exact, F.when(not_a_number, zero).otherwise(too_large))


def to_measure(c: str | Column, kind: T.DataType | None = None) -> Column:
    """Text or number -> double; unparseable, NaN or null -> 0."""
    c = col_(c)
    number = c.cast("double") if isinstance(kind, T.NumericType) else F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def exact_measure(c: str | Column) -> Column:
    """A measure as an exact number; a non-finite value raises (the cast would make it null and
    drop it from sums)."""
    c = col_(c)
    broken = F.raise_error(F.lit("a quantity is not finite: it has no exact sum")).cast(MONEY)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), broken).otherwise(c.cast(MONEY))


def exact_total(c: str | Column) -> Column:
    """Sum of a measure, exact to six decimals whatever the partitioning, as double."""
    return F.sum(exact_measure(c)).cast("double")


# The characters that count as white space at the ends of a flag.
STRIPPED = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
            "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_blanks(c: str | Column) -> Column:
    """Text without Unicode white space at either end."""
    return F.btrim(col_(c), F.lit(STRIPPED))


# --- P3 / P5 / P6 / P12: calendar parts and labels --------------------------

def month_label(c: str | Column) -> Column:
    """``YYYY-MM``; null date -> null."""
    return F.date_format(col_(c), "yyyy-MM")


def month_start(c: str | Column) -> Column:
    """First instant of the month, as a timestamp."""
    return F.date_trunc("month", col_(c))


def quarter_label(c: str | Column) -> Column:
    """``YYYYQn``: 2020-05-01 -> 2020Q2."""
    c = col_(c)
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def long_month_label(c: str | Column) -> Column:
    """``May 2020``."""
    return F.date_format(col_(c), "MMMM yyyy")


# --- P7: whole days ---------------------------------------------------------

def whole_days_between(later: str | Column, earlier: str | Column) -> Column:
    """Floor of the timestamp difference in days (01-01 23:00 -> 01-03 01:00 is 1)."""
    diff = F.unix_micros(col_(later)) - F.unix_micros(col_(earlier))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("long")


# --- P8 / P9: ratios --------------------------------------------------------

def guarded_ratio(num: str | Column, den: str | Column, otherwise: float = 0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``otherwise``; never divides by zero."""
    num, den = col_(num).cast("double"), col_(den).cast("double")
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(otherwise))


def growth_pct(current: str | Column, previous: str | Column) -> Column:
    """``(cur - prev) / prev * 100`` when ``prev > 0`` else 0."""
    cur, prev = col_(current).cast("double"), col_(previous).cast("double")
    return F.when(prev > 0, F.try_divide(cur - prev, prev) * 100.0).otherwise(F.lit(0.0))


def ratio_2dp(num: str | Column, den: str | Column) -> Column:
    """Half-even rounded ratio; null when the denominator is 0."""
    return F.bround(F.try_divide(col_(num).cast("double"), col_(den).cast("double")), 2)


# --- P10 / P11 / P13: labels ------------------------------------------------

def currency_label(c: str | Column, decimals: int = 0) -> Column:
    """``£1,235`` / ``£1,234.50`` (half-even, thousands separators)."""
    return F.concat(F.lit("£"), F.format_number(col_(c).cast("double"), decimals))


def plain_number(c: str | Column, decimals: int = 0) -> Column:
    """``1234.5`` -> ``1234`` (half-even on the exact value, no separators)."""
    return F.regexp_replace(F.format_number(col_(c).cast("double"), decimals), ",", "")


def signed_pct_label(c: str | Column) -> Column:
    """``+12.3%`` / ``-4.0%``."""
    c = col_(c).cast("double")
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), plain_number(c, 1), F.lit("%"))


def pct_label(c: str | Column) -> Column:
    """``12.3%`` from a fraction 0.123."""
    return F.concat(plain_number(col_(c).cast("double") * 100.0, 1), F.lit("%"))


def title_label(c: str | Column) -> Column:
    """``rolling_mean_3`` -> ``Rolling Mean 3``."""
    return F.initcap(F.regexp_replace(col_(c), "_", " "))


# --- P14 / P16: numeric guards ----------------------------------------------

def clip0(c: str | Column) -> Column:
    return F.greatest(col_(c), F.lit(0.0))


def finite_or_zero(c: str | Column) -> Column:
    """NaN, +inf, -inf, null -> 0."""
    c = col_(c).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def money_out(c: str | Column) -> Column:
    """Exact decimal sum -> double at the output boundary."""
    return col_(c).cast("double")
