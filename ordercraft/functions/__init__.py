"""Scalar column expressions shared by the operators."""

from .dates import (day_text, iso_week, ts_ntz, date_lit, week_ending_sunday,
                    year_lower_bound, month_short_name, fiscal_year_sep,
                    month_end_months_back, run_stamp)
from .text import (collapse_whitespace, coupon_code, units_label, full_name,
                   zone_label, sorted_distinct_text)

__all__ = [
    "day_text", "iso_week", "ts_ntz", "date_lit", "week_ending_sunday",
    "year_lower_bound", "month_short_name", "fiscal_year_sep",
    "month_end_months_back", "run_stamp",
    "collapse_whitespace", "coupon_code", "units_label", "full_name",
    "zone_label", "sorted_distinct_text",
]
