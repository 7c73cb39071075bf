"""Date expressions (E-1, E-2, E-3, E-6, E-7, E-8, E-16), all JVM-side Column builders."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week0(d: ColumnOrName) -> Column:
    """E-1: week of the year with Sunday as first day, 0..53 (MySQL ``WEEK(d)``, ``%U``).

    Not ``weekofyear`` (that is ISO). Days before the first Sunday are week 0.
    """
    d = _c(d)
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def week_start(d: ColumnOrName) -> Column:
    """The Sunday on or before ``d``: the key of a calendar week across a year end."""
    d = _c(d)
    return F.date_sub(d, F.dayofweek(d) - F.lit(1))


def last_saturday(d: ColumnOrName) -> Column:
    """E-6: the last Saturday on or before ``d``."""
    d = _c(d)
    return F.date_sub(d, F.dayofweek(d) % F.lit(7))


def iso_week(d: ColumnOrName) -> Column:
    """E-6: ISO week number."""
    return F.weekofyear(_c(d))


def weekday_name(d: ColumnOrName) -> Column:
    """E-6: weekday name, ``Sunday`` .. ``Saturday``."""
    return F.date_format(_c(d), "EEEE")


def month_num(d: ColumnOrName) -> Column:
    """E-2 / E-8: month number 1..12."""
    return F.month(_c(d)).cast("int")


def as_date(x: ColumnOrName, fmt: str | None = None) -> Column:
    """E-3 / E-7: ``DATE(x)``; with a format, parse text such as ``dd/MM/yyyy``.

    Strict: under ANSI mode a value that does not parse fails the job. For text from
    outside (crawled files, request tables) use ``try_as_date``.
    """
    x = _c(x)
    return F.to_date(x, fmt) if fmt else x.cast("date")


def try_as_date(x: ColumnOrName, fmt: str) -> Column:
    """Parse text as a date, null when it does not match (for reject columns)."""
    return F.try_to_timestamp(_c(x), F.lit(fmt)).cast("date")


def today_text() -> Column:
    """E-16: the day of the run as ``yyyy-MM-dd`` (names a snapshot)."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def parse_day(text: str | _dt.date) -> _dt.date:
    """Driver-side parse of a ``%Y-%m-%d`` parameter (F-6 raises before any Spark work)."""
    if isinstance(text, _dt.datetime):
        return text.date()
    if isinstance(text, _dt.date):
        return text
    return _dt.datetime.strptime(text, "%Y-%m-%d").date()


def py_week0(d: _dt.date) -> int:
    """The E-1 rule in plain Python, for parameters and tests."""
    return int(d.strftime("%U"))


def py_week_start(d: _dt.date) -> _dt.date:
    return d - _dt.timedelta(days=(d.weekday() + 1) % 7)
