"""Scalar column expressions: guards for nulls, NaN and infinities, and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """A double with NaN and infinities as null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(c: str | Column) -> Column:
    """A string or number as a finite double; what can't be read is null."""
    return finite(col(c).cast("string").try_cast("double"))


def rate(x: str | Column, base: str | Column) -> Column:
    """Percent change from base to x; null if either is missing or base is 0."""
    x, base = col(x), finite(base)
    return F.try_divide(x - base, base) * 100


def ratio(x: str | Column, y: str | Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


def rounded(c: str | Column, digits: int = 3) -> Column:
    """Rounded, with -0.0 as 0.0."""
    x = F.round(col(c), digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def clip(c: str | Column, low, high) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def code(c: str | Column, width: int = 6) -> Column:
    """An instrument code, zero-padded."""
    return F.when(F.length(col(c).cast("string")) >= width, col(c).cast("string")).otherwise(F.lpad(col(c).cast("string"), width, "0"))


def day_of(c: str | Column) -> Column:
    """A date from yyyy-MM-dd, yyyyMMdd or an RFC 1123 time; null if none fits."""
    s = F.trim(col(c).cast("string"))
    rfc = F.regexp_replace(s, "^[A-Za-z]{3}, ", "")
    parse = lambda text, fmt: F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), parse(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{8}$"), parse(s, "yyyyMMdd"))
        .when(rfc.rlike(r"^\d{2} [A-Za-z]{3} \d{4}"), parse(F.substring(rfc, 1, 11), "dd MMM yyyy"))
    )


def week_of(c: str | Column) -> Column:
    """The Friday that ends the week; Saturday and Sunday belong to the next."""
    return F.next_day(F.date_sub(col(c), 1), "FRI")


def month_of(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def quarter_of(c: str | Column) -> Column:
    return F.concat(F.year(col(c)).cast("string"), F.lit("Q"), F.quarter(col(c)).cast("string"))


def short_number(c: str | Column) -> Column:
    """1234567 as 1.2M, 12345 as 12.3K, below that with thousands marks."""
    x = col(c)
    return F.when(F.abs(x) >= 1e6, F.concat(F.format_number(x / 1e6, 1), F.lit("M"))).when(F.abs(x) >= 1e4, F.concat(F.format_number(x / 1e3, 1), F.lit("K"))).otherwise(F.format_number(x, 0))


def display_width(c: str | Column) -> Column:
    """Terminal columns: East Asian wide and full-width characters take two."""
    wide = F.regexp_count(col(c), F.lit("[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]"))
    return F.length(col(c)) + wide


def pad_display(c: str | Column, width: int) -> Column:
    return F.concat(col(c), F.repeat(F.lit(" "), F.greatest(F.lit(width) - display_width(c), F.lit(0))))


def field(c: str | Column, path: str, default) -> Column:
    """A JSON field by path, with a default where it is missing."""
    return F.coalesce(F.get_json_object(col(c), path), F.lit(default))
