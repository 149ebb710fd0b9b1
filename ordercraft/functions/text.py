"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace as Python's ``\s`` sees it: Java's Unicode ``\s`` plus the
# information separators 0x1c-0x1f, which Python counts as blanks.
WHITESPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"


def collapse_whitespace(c) -> Column:
    """Every run of whitespace becomes one blank; no trimming."""
    return F.regexp_replace(_as_col(c), WHITESPACE_RUN, " ")


def coupon_code(c) -> Column:
    """F8: the coupon code before the first ``:``; empty text otherwise.

    A null input has no ``:`` and gives empty text, as in the reference.
    """
    col = _as_col(c)
    return (F.when(F.coalesce(F.instr(col, ":") > 0, F.lit(False)),
                   F.substring_index(col, ":", 1))
            .otherwise(F.lit("")))


def units_label(name, quantity) -> Column:
    """``<name>-<quantity> Units``; a missing part prints ``nan``."""
    return F.concat(F.coalesce(_as_col(name).cast("string"), F.lit("nan")), F.lit("-"),
                    F.coalesce(_as_col(quantity).cast("string"), F.lit("nan")),
                    F.lit(" Units"))


def full_name(first, last) -> Column:
    """first + blank + last; null when either part is null."""
    return F.concat(_as_col(first), F.lit(" "), _as_col(last))


def zone_label(zone, states) -> Column:
    """``2-['NY', 'PA']`` -- a zone and its state list in list-print form."""
    quoted = F.transform(_as_col(states), lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(_as_col(zone).cast("string"), F.lit("-["),
                    F.array_join(quoted, ", "), F.lit("]"))


def sorted_distinct_text(c, sep: str = ", \n") -> Column:
    """Sorted distinct values joined by ``sep`` (an aggregate expression). A
    named column is made distinct by rows, so that a group's values are spread over
    tasks until the last step."""
    values = F.expr(f"collect_list(DISTINCT `{c}`)") if isinstance(c, str) else F.collect_set(c)
    return F.array_join(F.sort_array(values), sep)
