"""Dates that arrive as text or number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ymd(col: Column) -> Column:
    """The date of ``yyyyMMdd``; null if there is no such day."""
    return F.when(col.rlike(r"^\d{8}$"), F.try_to_date(col, "yyyyMMdd"))


def parse_date_loose(col: Column) -> Column:
    """As D1, for ``20150127.0`` too; other texts as ISO dates.

    Numbers that are no date give null.
    """
    text = col.cast("string")
    number = text.try_cast("double")
    digits = number.try_cast("bigint").cast("string")
    return F.coalesce(parse_ymd(digits), F.when(number.isNull(), text.try_cast("date")))


def with_periods(df: DataFrame, date: str = "date") -> DataFrame:
    """D3: adds year, month (its first day) and year_month (``yyyy-MM``)."""
    return df.withColumns({"year": F.year(date), "month": F.trunc(date, "MM"), "year_month": F.date_format(date, "yyyy-MM")})


def month_end(col: Column) -> Column:
    """The last day of a date's month."""
    return F.last_day(col)
