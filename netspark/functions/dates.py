"""Dates as days since 1899-12-30 with a fraction of a day, and back: the decimal form of simulation files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Days from the decimal form's origin to 1970-01-01.
ORIGIN = 25569


def encode_date(year: Column, month: Column, day: Column) -> Column:
    """Days of a date; null where there is no such date."""
    return (F.datediff(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.lit("1970-01-01").cast("date")) + ORIGIN).cast("double")


def encode_time(hour: Column, minute: Column, second: Column) -> Column:
    """The share of a day."""
    return (hour * 3600 + minute * 60 + second) / 86400.0


def _seconds(days: Column) -> Column:
    """Whole seconds since 1970, rounded: fractions of days are not exact."""
    return F.rint((days - ORIGIN) * 86400).cast("long")


def as_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_seconds(days) / 86400).cast("int"))


def year(days: Column) -> Column:
    return F.year(as_date(days))


def month(days: Column) -> Column:
    return F.month(as_date(days))


def day(days: Column) -> Column:
    return F.dayofmonth(as_date(days))


def hour(days: Column) -> Column:
    return F.floor(F.pmod(_seconds(days), F.lit(86400)) / 3600).cast("int")


def minute(days: Column) -> Column:
    return F.floor(F.pmod(_seconds(days), F.lit(3600)) / 60).cast("int")


def second(days: Column) -> Column:
    return F.pmod(_seconds(days), F.lit(60)).cast("int")


def day_of_year(days: Column) -> Column:
    return F.dayofyear(as_date(days))


def day_of_week(days: Column) -> Column:
    """1 for Sunday to 7."""
    return F.dayofweek(as_date(days))


def days_in_month(year_: Column, month_: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year_, month_, F.lit(1))))


def add_seconds(days: Column, seconds: Column) -> Column:
    return days + seconds / 86400.0


def add_days(days: Column, more: Column) -> Column:
    return days + more


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from ``b`` to ``a``."""
    return _seconds(a) - _seconds(b)


def written(days: Column, pattern: str = "MM/dd/yyyy") -> Column:
    """A date as text."""
    return F.date_format(as_date(days), pattern)


def read(text: Column, pattern: str = "M/d/yyyy") -> Column:
    """Days of a date's text; null where it is none."""
    return (F.datediff(F.try_to_timestamp(text, F.lit(pattern)).cast("date"), F.lit("1970-01-01").cast("date")) + ORIGIN).cast("double")


def read_time(text: Column) -> Column:
    """The share of a day of ``h``, ``h:mm`` or ``h:mm:ss``; whole or decimal hours without a colon."""
    parts = F.split(text, ":")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(F.exists(parts, lambda p: p.try_cast("double").isNull()), None).otherwise((at(1) * 3600 + at(2) * 60 + at(3)) / 86400.0)
