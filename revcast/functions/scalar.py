"""Scalar column expressions (all JVM-side, codegen-friendly).

Every helper takes and returns ``Column`` objects so callers can compose
them inside one projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay as they are for identical results):
# letters that may lead a credit/adjustment invoice number: "A", "C"
INVOICE_PREFIX_LETTERS = "AC"
# the key of the whole-market series
ALL_SERIES = "all"

# Amounts are summed at the source's scale (up to six decimals), never rounded
# line by line; they become double only at the output.
MONEY_TYPE = "decimal(28,6)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero_pad(x, width: int = 2) -> Column:
    """left-pad a number or string with zeros to ``width`` characters."""
    return F.lpad(_c(x).cast("string"), width, "0")


def date_from_parts(year, month, day, strict: bool = False) -> Column:
    """build a date from string parts such as '2018', '1', '5'.

    Parts are zero-padded first; unparseable combinations give null
    (``try_to_date``) unless ``strict``, where ANSI mode raises.
    """
    s = F.concat_ws("-", _c(year).cast("string"), zero_pad(month), zero_pad(day))
    if strict:
        return F.to_date(s, "yyyy-MM-dd")
    return F.try_to_date(s, "yyyy-MM-dd")


def clean_invoice(x) -> Column:
    """F3 / SD4: remove every non-digit from an invoice number."""
    return F.regexp_replace(_c(x), r"\D+", "")


def strip_invoice_letters(x) -> Column:
    """strip the letters A and C from both ends of an invoice number."""
    return F.btrim(_c(x), F.lit(INVOICE_PREFIX_LETTERS))


def slug(x) -> Column:
    """lower-case, runs of whitespace become one underscore."""
    return F.regexp_replace(F.lower(_c(x)), r"\s+", "_")


def year_month(d) -> Column:
    """'yyyy-MM' of a date."""
    return F.date_format(_c(d), "yyyy-MM")


def month_label(d) -> Column:
    """F8: full English month name and year, e.g. 'November_2017'."""
    return F.date_format(_c(d), "MMMM_yyyy")


def day_number(d) -> Column:
    """Integer day index (days since 1970-01-01), the order key of RANGE frames."""
    return F.unix_date(_c(d))


def date_spine(start, stop) -> Column:
    """array of every date from start to stop inclusive."""
    return F.sequence(_c(start), _c(stop), F.expr("interval 1 day"))


def hms_duration(seconds) -> Column:
    """seconds formatted as 'HHH:MM:SS' (hours padded to 3 digits)."""
    s = F.floor(_c(seconds)).cast("bigint")
    h = F.floor(s / 3600).cast("bigint")
    m = F.floor((s % 3600) / 60).cast("bigint")
    sec = s % 60
    return F.concat_ws(":", F.lpad(h.cast("string"), 3, "0"),
                       F.lpad(m.cast("string"), 2, "0"),
                       F.lpad(sec.cast("string"), 2, "0"))


def version_tag(v) -> Column:
    """model version as a name fragment: every '.' becomes '_'."""
    return F.replace(_c(v).cast("string"), F.lit("."), F.lit("_"))


def money(x) -> Column:
    """Exact money: amounts keep the source's scale and are only turned into
    double at the output, so partial sums never depend on addition order."""
    return _c(x).cast(MONEY_TYPE)


def rounded_rmse(mse) -> Column:
    """``round(sqrt(mse))``."""
    return F.round(F.sqrt(_c(mse)))


def to_cents(x) -> Column:
    """A double amount rounded half up to whole cents, as decimal(18,2).

    The rounding is done explicitly (``floor(x·100 + 0.5) / 100``) so every
    engine produces the same cent for values that sit exactly on a tie.
    """
    return (F.floor(_c(x) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)).cast("decimal(18,2)")
