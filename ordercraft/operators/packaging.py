"""Packaging usage (Q30-Q33): per-row rules, inventory counts turned wide by
month with last month's use, and production paperwork per month.

The per-row rules are ``when`` chains evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sorted_distinct_text
from ..session import materialize
from .stats import group_values
from .subtotals import dense_periods, distinct_values, previous_period

# Blank marker, product-number prefixes, transfer codes, and the
# retail multiplier for made (IR) units of an assembled product.
BLANK = "-"
PREFIX_ISSUE, PREFIX_ASSEMBLY, PREFIX_PRODUCT = "P0", "A", "PR"
CODE_ISSUED, CODE_MADE = "II", "IR"
RETAIL_UNITS_PER_ASSEMBLY = 6
PACKAGING_TYPE = "packaging"


def packaging_used_expr(packaging_col: str = "packaging", retail: bool = False) -> Column:
    """Q30/Q31: packaging used by one production row.

    blank packaging -> 0; ``P0``: issued units (absolute) else 0; ``A``: made
    units (x6 for retail) else 0; ``PR`` (bulk only): made units else 0; any
    other prefix -> null. Prefixes are tested in that order.
    """
    pn, code, units = F.col("product_num"), F.col("transfer_code"), F.col("transaction_units")
    made_mult = RETAIL_UNITS_PER_ASSEMBLY if retail else 1
    e = (F.when(F.col(packaging_col) == BLANK, F.lit(0.0))
         .when(pn.startswith(PREFIX_ISSUE),
               F.when(code == CODE_ISSUED, F.abs(units * -1)).otherwise(F.lit(0.0)))
         .when(pn.startswith(PREFIX_ASSEMBLY),
               F.when(code == CODE_MADE, units * made_mult).otherwise(F.lit(0.0))))
    if not retail:
        e = e.when(pn.startswith(PREFIX_PRODUCT),
                   F.when(code == CODE_MADE, units).otherwise(F.lit(0.0)))
    return e.cast("double")


def inventory_by_month(inv: DataFrame, packaging_col: str = "packaging",
                       used_col: str = "used_last_month") -> DataFrame:
    """Q32 in long form (W5): one row per (packaging, item, month end) on the dense
    grid, with the count and the use since the month before (null if either month
    has no count). Any number of months; nothing is collected."""
    f = inv.filter((F.col(packaging_col) != BLANK) & (F.col("type") == PACKAGING_TYPE))
    keys = [packaging_col, "item_code"]
    counts = f.groupBy(*keys, "date").agg(F.sum("inventory_count").alias("inventory_count"))
    dense = dense_periods(counts.filter(F.col("date").isNotNull()), keys, "date")
    return dense.withColumn(used_col, F.col("inventory_count")
                            - previous_period(dense, keys, "date", "inventory_count"))


def inventory_summary(inv: DataFrame, months: Sequence | None = None,
                      packaging_col: str = "packaging",
                      used_col: str = "used_last_month") -> DataFrame:
    """Q32: counts per (packaging, item) with one column per month end and the
    use in the last month (latest minus previous; null if either is missing),
    sorted by that use (nulls last).

    ``months`` is the pivot value list in ascending order (its last two are
    the compared months). ``None`` takes every month end present (as the
    reference does) from the long form, which is written once. With fewer than
    two months the use is null.
    """
    keys = [packaging_col, "item_code"]
    if months is not None:
        f = inv.filter((F.col(packaging_col) != BLANK) & (F.col("type") == PACKAGING_TYPE))
        long = f.groupBy(*keys, "date").agg(F.sum("inventory_count").alias("inventory_count"))
        months = list(months)
    else:
        long = materialize(inventory_by_month(inv, packaging_col, used_col), "inventory_by_month")
        months = distinct_values(long, "date")
    wide = long.groupBy(*keys).pivot("date", months).agg(F.first("inventory_count", ignorenulls=True))
    names = [str(m) for m in months]
    wide = wide.withColumn(used_col, F.col(f"`{names[-1]}`") - F.col(f"`{names[-2]}`")
                           if len(names) > 1 else F.lit(None).cast("double"))
    return wide.orderBy(F.col(used_col).asc_nulls_last(), *keys)


def month_mask(month: int, year: int, a: str = "date_transaction",
               b: str = "date_production") -> Column:
    """Month on either date and year on either date (not necessarily the same one)."""
    return (((F.month(a) == month) | (F.month(b) == month))
            & ((F.year(a) == year) | (F.year(b) == year)))


def production_usage(prod: DataFrame, month: int, year: int, retail: bool = False) -> DataFrame:
    """Q33: packaging used in a month per packaging, with its sorted product list."""
    pack = "packaging_retail" if retail else "packaging"
    used = "packaging_used_retail" if retail else "packaging_used"
    rows = prod.withColumn(used, packaging_used_expr(pack, retail))
    rows = rows.filter(month_mask(month, year) & (F.col(pack) != BLANK))
    return (rows.groupBy(pack)
                .agg(F.coalesce(F.sum(used), F.lit(0.0)).alias(used),
                     sorted_distinct_text("product").alias("product")))


def production_products(prod: DataFrame, month: int, year: int, retail: bool = False) -> DataFrame:
    """Q33 in long form: the distinct products per packaging, one row each."""
    pack = "packaging_retail" if retail else "packaging"
    return group_values(prod.filter(month_mask(month, year) & (F.col(pack) != BLANK)),
                        [pack], "product")
