"""Date and time column expressions (F1-F6, B1/B2 bucket keys, bounds)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(value: str | _dt.date | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables load as timestamp_ntz).

    Written as a SQL literal so it is foldable and comparisons with it reach
    the Parquet scan as pushed filters.
    """
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def date_lit(value: str | _dt.date) -> Column:
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value[:10])
    return F.expr(f"DATE '{value.isoformat()}'")


def day_text(c) -> Column:
    """date as ``YYYY-MM-DD`` text."""
    return F.date_format(_as_col(c), "yyyy-MM-dd")


def iso_week(c) -> Column:
    """ISO week number (2018-12-31 is week 1, 2021-01-01 is week 53)."""
    return F.weekofyear(_as_col(c))


def week_ending_sunday(c) -> Column:
    """B2: Monday-Sunday week labelled by its Sunday, as a DATE.

    Sunday 10:00 belongs to that Sunday; Monday 00:00 starts the next week.
    """
    return F.date_add(F.to_date(F.date_trunc("week", _as_col(c))), 6)


def year_lower_bound(c, year: int) -> Column:
    """P6 written as a date range so it pushes down (``year(d) >= y``)."""
    return _as_col(c) >= ts_ntz(_dt.datetime(year, 1, 1))


def month_short_name(c) -> Column:
    """month number (1-12) to its short English name."""
    return F.date_format(F.make_date(F.lit(2000), _as_col(c), F.lit(1)), "MMM")


def fiscal_year_sep(c) -> Column:
    """fiscal year of a date for a year ending in September."""
    return F.year(F.add_months(F.to_date(_as_col(c)), 3))


def fiscal_quarter_sep(c) -> Column:
    """quarter (1-4) of the fiscal year ending in September; October starts the first."""
    return F.quarter(F.add_months(F.to_date(_as_col(c)), 3))


def fiscal_quarter_end(c) -> Column:
    """last day of the fiscal quarter of a date."""
    return F.last_day(F.add_months(F.trunc(_as_col(c), "quarter"), 2))


def fiscal_year_end(c) -> Column:
    """last day (30 September) of the fiscal year of a date."""
    return F.make_date(fiscal_year_sep(c), F.lit(9), F.lit(30))


def month_end_months_back(c, months: int = 3) -> Column:
    """the month end ``months`` months before the month of ``c``."""
    return F.last_day(F.add_months(F.to_date(_as_col(c)), -months))


# The two run-stamp formats of the reports.
RUN_STAMP_12H = "MM/dd/yyyy - hh:mm a"
RUN_STAMP_24H = "MM/dd/yyyy - HH-mm"


def run_stamp(fmt: str = RUN_STAMP_12H) -> Column:
    """the run time as text, for an as-of column on exported tables."""
    return F.date_format(F.current_timestamp(), fmt)
