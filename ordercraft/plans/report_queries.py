"""Registered analyses for the management reports: nested subtotals (Q28),
period differences (Q29) and packaging usage (Q30-Q33)."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import functions as F

from ..operators import packaging, subtotals
from .catalog import decimals_to_double, register, tables
from .views_sql import with_views

# Fixed values for the test tables: T7 keys/measure (FIXTURES.md) and the report
# months. Pivot columns (states, years, month ends) come from the data.
SUB_KEYS = ["customer_state", "product_options", "product_name"]
SUB_VALUE = "product_quantity"
YTD_MONTH = 6
YTD_KEYS = ["year", "customer_state", "product_options"]
PROD_MONTH, PROD_YEAR = 6, 1999


def _stacked_levels_sql(src: str, keys: list[str], values: list[tuple[str, str]]) -> str:
    """The levels as the reference builds them: one grouped query per level,
    lower keys replaced by the total label, stacked."""
    parts = []
    for i in range(1, len(keys) + 1):
        sel = [k if j < i else f"'[Total]' as {k}" for j, k in enumerate(keys)]
        grp = ", ".join(keys[:i])
        nn = " and ".join(f"{k} is not null" for k in keys[:i])
        vals = ", ".join(f"{expr} as {name}" for name, expr in values)
        parts.append(f"select {', '.join(sel)}, {vals} from {src} where {nn} group by {grp}")
    return "\nunion all\n".join(parts)


QTY_SUM = [(SUB_VALUE, f"cast(coalesce(sum({SUB_VALUE}), 0) as bigint)")]


@register("q28_subtotals_long", with_views(["sales"], _stacked_levels_sql("sales", SUB_KEYS,
                                                                          QTY_SUM)))
def q28_subtotals_long(spark, sf_dir):
    return subtotals.subtotals(tables(spark, sf_dir).sales, SUB_VALUE, SUB_KEYS)


# Fixed values of the test tables: the states, years and month ends that become
# columns. The Spark side takes its columns from the data, so a missing or new
# one shows as a difference.
STATES = [f"NATION_{i}" for i in range(25)]
YEARS = list(range(1995, 2002))
MONTH_ENDS = [dt.date(y, m, calendar.monthrange(y, m)[1]).isoformat()
              for y in YEARS for m in range(1, 13) if (y, m) <= (2001, 11)]


def _columns_sql(first: str, wanted: list, value: str, how: str = "max") -> str:
    return ", ".join(f"""{how}(case when {first} = '{x}' then {value} end) as "{x}" """ for x in wanted)


def _wide_sql(first: str, wanted: list, rest: list[str], value: str, src: str = "long_form") -> str:
    """One column per wanted value of ``first``."""
    return f"select {', '.join(rest)}, {_columns_sql(first, wanted, value)} from {src} group by {', '.join(rest)}"


@register("q28_subtotals_wide", with_views(
    ["sales"], _wide_sql(SUB_KEYS[0], STATES, SUB_KEYS[1:], SUB_VALUE),
    [("long_form", _stacked_levels_sql("sales", SUB_KEYS, QTY_SUM))]))
def q28_subtotals_wide(spark, sf_dir):
    return subtotals.subtotals_wide(tables(spark, sf_dir).sales, SUB_VALUE, SUB_KEYS)


MULTI_VALUES = QTY_SUM + [("product_price_x_quantity",
                           "cast(coalesce(sum(product_price * product_quantity), 0) as double)")]


@register("q28_subtotals_multi_measure", with_views(["sales"], _stacked_levels_sql(
    "sales", SUB_KEYS, MULTI_VALUES)))
def q28_subtotals_multi_measure(spark, sf_dir):
    s = tables(spark, sf_dir).sales.withColumn(
        "product_price_x_quantity", F.col("product_price") * F.col("product_quantity"))
    return decimals_to_double(subtotals.subtotals(
        s, [SUB_VALUE, "product_price_x_quantity"], SUB_KEYS))


@register("q28_subtotals_any_aggregate", with_views(["sales"], _stacked_levels_sql(
    "sales", SUB_KEYS, [
        (SUB_VALUE, f"max({SUB_VALUE})"),
        ("product_price", "cast(min(product_price) as double)"),
        ("customer_email", "count(distinct customer_email)"),
        ("product_weight", "avg(product_weight)")])))
def q28_subtotals_any_aggregate(spark, sf_dir):
    how = {SUB_VALUE: F.max, "product_price": F.min, "customer_email": F.count_distinct,
           "product_weight": F.avg}
    return decimals_to_double(subtotals.subtotals(tables(spark, sf_dir).planned.sales, list(how),
                                                  SUB_KEYS, aggregates=how))


YTD_SRC = ("ytd_src", f"""select cast(year(transaction_date) as integer) as year, *
  from sales where month(transaction_date) <= {YTD_MONTH}""")
YTD_LONG = ("long_form", _stacked_levels_sql("ytd_src", YTD_KEYS, QTY_SUM))


def _ytd_wide(spark, sf_dir):
    s = tables(spark, sf_dir).sales.withColumn("year", F.year("transaction_date"))
    return subtotals.subtotals_by_period(s, "ytd", "transaction_date", YTD_MONTH, SUB_VALUE,
                                         YTD_KEYS)


@register("q28_subtotals_ytd_by_year", with_views(
    ["sales"], _wide_sql("year", YEARS, YTD_KEYS[1:], SUB_VALUE), [YTD_SRC, YTD_LONG]))
def q28_subtotals_ytd_by_year(spark, sf_dir):
    return _ytd_wide(spark, sf_dir)


_rest = ", ".join(YTD_KEYS[1:])


DENSE_CTE = ("dense", f"""select k.*, y.year, coalesce(l.{SUB_VALUE}, 0) as {SUB_VALUE}
       from (select distinct {_rest} from long_form) k
       cross join (select distinct year from long_form) y
       left join long_form l using ({_rest}, year)""")


@register("q29_period_difference", with_views(["sales"], f"""
select w.*, d.last - d.prev as difference,
 cast(d.last as double) / nullif(cast(d.prev as double), 0) - 1.0 as difference_pct
from (select {_rest}, {_columns_sql('year', YEARS, SUB_VALUE)} from dense group by {_rest}) w join diff d using ({_rest})""", [
    YTD_SRC, YTD_LONG, DENSE_CTE,
    ("diff", f"""select {_rest},
       max(case when year = (select max(year) from dense) then {SUB_VALUE} end) as last,
       max(case when year = (select max(year) from dense
             where year < (select max(year) from dense)) then {SUB_VALUE} end) as prev
       from dense group by {_rest}""")]))
def q29_period_difference(spark, sf_dir):
    wide = _ytd_wide(spark, sf_dir)
    return subtotals.diff_and_percent(wide, [c for c in wide.columns if c not in YTD_KEYS])


@register("q29_period_difference_long", with_views(["sales"], f"""
select {_rest}, year, {SUB_VALUE}, {SUB_VALUE} - lag({SUB_VALUE}) over w as difference,
 cast({SUB_VALUE} as double) / nullif(cast(lag({SUB_VALUE}) over w as double), 0) - 1.0 as difference_pct
from dense window w as (partition by {_rest} order by year)""", [YTD_SRC, YTD_LONG, DENSE_CTE]))
def q29_period_difference_long(spark, sf_dir):
    """Every year against the one before, for all nested keys, without a pivot."""
    s = tables(spark, sf_dir).sales.withColumn("year", F.year("transaction_date"))
    long = subtotals.subtotals(subtotals.period_filter(s, "ytd", "transaction_date", YTD_MONTH), SUB_VALUE, YTD_KEYS)
    return subtotals.period_differences(long, YTD_KEYS[1:], "year", SUB_VALUE)


# ------------------------------------------------------------------ Q30-Q33
def _used_sql(pack: str, retail: bool) -> str:
    mult = packaging.RETAIL_UNITS_PER_ASSEMBLY if retail else 1
    pr = "" if retail else ("when starts_with(product_num, 'PR') then case when transfer_code = "
                            "'IR' then transaction_units else 0.0 end ")
    return (f"cast(case when {pack} = '-' then 0.0 "
            "when starts_with(product_num, 'P0') then case when transfer_code = 'II' "
            "then abs(transaction_units * -1) else 0.0 end "
            "when starts_with(product_num, 'A') then case when transfer_code = 'IR' "
            f"then transaction_units * {mult} else 0.0 end {pr}end as double)")


PROD_COLS = ["packaging", "packaging_retail", "product", "product_num", "transfer_code",
             "transaction_units", "date_transaction", "date_production"]


@register("q30_packaging_used", with_views(["production"], f"""
select {', '.join(PROD_COLS)}, {_used_sql('packaging', False)} as packaging_used
from production"""))
def q30_packaging_used(spark, sf_dir):
    p = tables(spark, sf_dir).production
    return p.withColumn("packaging_used", packaging.packaging_used_expr("packaging", False))


@register("q31_packaging_used_retail", with_views(["production"], f"""
select {', '.join(PROD_COLS)}, {_used_sql('packaging_retail', True)} as packaging_used_retail
from production"""))
def q31_packaging_used_retail(spark, sf_dir):
    p = tables(spark, sf_dir).planned.production
    return p.withColumn("packaging_used_retail",
                        packaging.packaging_used_expr("packaging_retail", True))


def _inventory_sql(pack: str) -> str:
    last = "(select max(date) from counts)"
    prev = f"(select max(date) from counts where date < {last})"
    return with_views(["inventory"], f"""
select w.*, d.used_last_month
from (select {pack}, item_code, {_columns_sql('date', MONTH_ENDS, 'inventory_count', 'sum')}
      from counts group by {pack}, item_code) w
join (select {pack}, item_code,
        sum(inventory_count) filter (where date = {last})
        - sum(inventory_count) filter (where date = {prev}) as used_last_month
      from counts group by 1, 2) d using ({pack}, item_code)""", [
        ("counts", f"select {pack}, item_code, date, inventory_count from inventory "
                   f"where {pack} <> '-' and type = 'packaging'")])


for _pack in ("packaging", "packaging_retail"):
    def _inv(spark, sf_dir, _p=_pack):
        return packaging.inventory_summary(tables(spark, sf_dir).inventory, None, _p)
    register(f"q32_inventory_summary_{'bulk' if _pack == 'packaging' else 'retail'}",
             _inventory_sql(_pack))(_inv)


def _inventory_long_sql(pack: str) -> str:
    return with_views(["inventory"], f"""
select {pack}, item_code, date, inventory_count, inventory_count - lag(inventory_count)
  over (partition by {pack}, item_code order by date) as used_last_month
from (select k.*, m.date, c.inventory_count from (select distinct {pack}, item_code from counts) k
      cross join (select distinct date from counts) m left join counts c using ({pack}, item_code, date)) g""", [
        ("counts", f"select {pack}, item_code, date, sum(inventory_count) as inventory_count from inventory "
                   f"where {pack} <> '-' and type = 'packaging' group by all")])


for _pack in ("packaging", "packaging_retail"):
    def _inv_long(spark, sf_dir, _p=_pack):
        return packaging.inventory_by_month(tables(spark, sf_dir).inventory, _p)
    register(f"q32_inventory_by_month_{'bulk' if _pack == 'packaging' else 'retail'}",
             _inventory_long_sql(_pack))(_inv_long)


def _production_sql(pack: str, retail: bool) -> str:
    used = "packaging_used_retail" if retail else "packaging_used"
    return with_views(["production"], f"""
select {pack}, coalesce(sum(u), 0.0) as {used},
 array_to_string(list_sort(list_distinct(list(product))), ', ' || chr(10)) as product
from (select *, {_used_sql(pack, retail)} as u from production) p
where (month(date_transaction) = {PROD_MONTH} or month(date_production) = {PROD_MONTH})
  and (year(date_transaction) = {PROD_YEAR} or year(date_production) = {PROD_YEAR})
  and {pack} <> '-'
group by 1""")


for _retail in (False, True):
    def _prod(spark, sf_dir, _r=_retail):
        return packaging.production_usage(tables(spark, sf_dir).production, PROD_MONTH,
                                          PROD_YEAR, retail=_r)
    register(f"q33_production_usage_{'retail' if _retail else 'bulk'}",
             _production_sql("packaging_retail" if _retail else "packaging", _retail))(_prod)


def _products_sql(pack: str) -> str:
    return with_views(["production"], f"""
select distinct {pack}, product from production
where (month(date_transaction) = {PROD_MONTH} or month(date_production) = {PROD_MONTH})
  and (year(date_transaction) = {PROD_YEAR} or year(date_production) = {PROD_YEAR})
  and {pack} <> '-' and product is not null""")


for _retail in (False, True):
    def _products(spark, sf_dir, _r=_retail):
        return packaging.production_products(tables(spark, sf_dir).production, PROD_MONTH,
                                             PROD_YEAR, retail=_r)
    register(f"q33_production_products_{'retail' if _retail else 'bulk'}",
             _products_sql("packaging_retail" if _retail else "packaging"))(_products)


YOY_SRC = ("yoy_src", "select cast(year(transaction_date) as integer) as year, * from sales")


@register("q28_subtotals_yoy_by_year", with_views(
    ["sales"], _wide_sql("year", YEARS, YTD_KEYS[1:], SUB_VALUE),
    [YOY_SRC, ("long_form", _stacked_levels_sql("yoy_src", YTD_KEYS, QTY_SUM))]))
def q28_subtotals_yoy_by_year(spark, sf_dir):
    s = tables(spark, sf_dir).sales.withColumn("year", F.year("transaction_date"))
    return subtotals.subtotals_by_period(s, "yoy", "transaction_date", YTD_MONTH, SUB_VALUE,
                                         YTD_KEYS)
