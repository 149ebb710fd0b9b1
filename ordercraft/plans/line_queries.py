"""Registered analyses over order lines: cleaning (Q1, C3), counts (Q2-Q4),
zones and the ship log (Q17-Q23), repeat customers (Q20), calendar buckets
(B1, B2, Q24-Q27), the joint-chart data (Q19) and the sales summary (Q34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, clean, customers, enrich, positions, shipping, stats
from ..operators.fill import find_hot_keys, forward_fill
from .catalog import (CUTOVER, SINCE, START, decimals_to_double, register, tables)
from .order_queries import MARGIN_CTES, Y_CTES, Y_VIEWS, _margin_table
from .views_sql import with_views

RAW_FILL_COLS = ["transaction_date", "customer_last_name", "customer_state", "shipping_total",
                 "discount_total", "order_total", "product_name", "product_options",
                 "product_price", "product_weight", "product_quantity"]
ORDER_LEVEL_FILL = ["transaction_date", "customer_last_name", "customer_state",
                    "shipping_total", "discount_total", "order_total"]


def _lines(spark, sf_dir):
    return enrich.prepare_lines(tables(spark, sf_dir).sales, cutover=CUTOVER)


def _fill_sql(src: str, cols: list[str], tiebreak: str, keep: list[str]) -> str:
    fills = ",\n ".join(f"last_value(r.{c} IGNORE NULLS) OVER w AS {c}" for c in cols)
    return (f"select {', '.join('r.' + k for k in keep)},\n {fills}\nfrom {src} r\n"
            f"window w as (partition by r.transaction_id order by r.transaction_date asc nulls "
            f"last, {tiebreak} rows between unbounded preceding and current row)")


# ------------------------------------------------------------------ C3 / Q1
FILL_OUT_SQL = ("transaction_id, line_seq, transaction_date, customer_last_name, customer_state, "
                "shipping_total, discount_total, cast(order_total as double) as order_total")


@register("c03_forward_fill", with_views(["raw_sales"], f"select {FILL_OUT_SQL} from f", [
    ("f", _fill_sql("raw_sales", ORDER_LEVEL_FILL, "r.line_seq", ["transaction_id", "line_seq"]))]))
def c03_forward_fill(spark, sf_dir):
    raw = tables(spark, sf_dir).raw_sales
    out = forward_fill(raw, "transaction_id", "transaction_date", ["line_seq"], ORDER_LEVEL_FILL)
    return decimals_to_double(out.select("transaction_id", "line_seq", *ORDER_LEVEL_FILL))


@register("c03_forward_fill_chunked", with_views(["raw_sales"], f"select {FILL_OUT_SQL} from f", [
    ("f", _fill_sql("raw_sales", ORDER_LEVEL_FILL, "r.line_seq", ["transaction_id", "line_seq"]))]))
def c03_forward_fill_chunked(spark, sf_dir):
    """The segmented-scan path of the fill applied to every order, with chunks
    of two lines so that each order spans several chunks (checks the carry)."""
    from ..session import materialize
    # ordered, numbered and filled lines move several times: with the columns of the result only
    raw = tables(spark, sf_dir).planned.raw_sales.select("transaction_id", "line_seq", *ORDER_LEVEL_FILL)
    raw = materialize(raw, "fill_input")
    out = forward_fill(raw, "transaction_id", "transaction_date", ["line_seq"], ORDER_LEVEL_FILL,
                       hot_keys="all", chunk_rows=2)
    return decimals_to_double(out.select("transaction_id", "line_seq", *ORDER_LEVEL_FILL))


CLEAN_TEXT = ["customer_last_name", "customer_state", "product_options"]
CLEAN_INT = ["shipping_total", "discount_total", "product_weight", "product_quantity"]


def _clean_sql(src: str, tiebreak: str) -> tuple[list[tuple[str, str]], str]:
    ctes = [("f", _fill_sql(src, RAW_FILL_COLS, tiebreak, ["transaction_id"])),
            ("dd", f"select distinct * from f where transaction_date >= TIMESTAMP '{START}'")]
    body = (
        "select transaction_id, transaction_date, "
        + ", ".join(f"coalesce({c}, '-') as {c}" for c in CLEAN_TEXT) + ", "
        + ", ".join(f"coalesce({c}, 0) as {c}" for c in CLEAN_INT) + ", "
        "coalesce(regexp_replace(product_name, '\\s+', ' ', 'g'), '-') as product_name, "
        "cast(coalesce(order_total, 0) as double) as order_total, "
        "cast(coalesce(product_price, 0) as double) as product_price, "
        "cast(coalesce(product_price * product_quantity, 0) as double) as product_price_x_quantity, "
        f"case when transaction_date >= TIMESTAMP '{CUTOVER}' then 'Post' else 'Pre' end as pre_post "
        "from dd")
    return ctes, body


_q1_ctes, _q1_body = _clean_sql("raw_sales", "r.line_seq")


@register("q01_clean_lines", with_views(["raw_sales"], _q1_body, _q1_ctes))
def q01_clean_lines(spark, sf_dir):
    raw = tables(spark, sf_dir).raw_sales
    return decimals_to_double(clean.clean_order_lines(raw, start=START, cutover=CUTOVER))


_q1p_ctes, _q1p_body = _clean_sql("raw_pulls", "r.pull, r.line_seq")


@register("q01_clean_overlapping_pulls", with_views(["raw_pulls"], _q1p_body, _q1p_ctes))
def q01_clean_overlapping_pulls(spark, sf_dir):
    raw = tables(spark, sf_dir).raw_pulls
    return decimals_to_double(clean.clean_order_lines(
        raw, start=START, cutover=CUTOVER, order_tiebreaks=("pull", "line_seq"),
        drop_after_fill=("pull", "line_seq")))


# ------------------------------------------------------------------ Q2-Q4
@register("q02_orders_per_day", with_views(["sales"], """
select strftime(transaction_date, '%Y-%m-%d') as transaction_date,
 count(distinct transaction_id) as num_of_tran
from sales group by 1"""))
def q02_orders_per_day(spark, sf_dir):
    return calendar.orders_per_day(_lines(spark, sf_dir))


@register("q03_distinct_customers", with_views(["sales"], """
select distinct customer_email, customer_first_name, customer_last_name from sales"""))
def q03_distinct_customers(spark, sf_dir):
    return customers.distinct_customers(tables(spark, sf_dir).sales)


SALES_COLS = ["transaction_id", "transaction_date", "customer_first_name", "customer_last_name",
              "customer_state", "customer_postal_code", "customer_email", "customer_phone",
              "shipping_first_name", "shipping_last_name", "shipping_address1", "shipping_city",
              "shipping_state", "shipping_postal_code", "shipping_phone", "product_name",
              "product_code", "product_options",
              "item_code", "product_price", "product_weight", "product_quantity",
              "shipping_total", "discount_total", "order_total", "coupons_used", "line_seq"]
SALES_SQL_COLS = ", ".join(f"cast({c} as double) as {c}" if c in ("product_price", "order_total")
                           else c for c in SALES_COLS)


@register("q04_multi_line_orders", with_views(["sales"], f"""
select {SALES_SQL_COLS} from sales
where transaction_id in (select transaction_id from sales group by 1 having count(*) > 2)"""))
def q04_multi_line_orders(spark, sf_dir):
    t = tables(spark, sf_dir)
    large = find_hot_keys(t.lineitem, "l_orderkey", enrich.HOT_ORDER_LINES)
    return decimals_to_double(customers.multi_line_orders(t.planned.sales, hot_orders=large))


# ------------------------------------------------------------------ Q17-Q19
ZONE_CTES = [
    ("zk", """select distinct pricing_zone, recipient_state, tracking_no from fedex
              where pricing_zone is not null and pricing_zone <> 'Non Zone'"""),
    ("zkk", """select recipient_state, cast(pricing_zone as integer) as pricing_zone,
               count(*) as n from zk group by 1, 2"""),
    ("zbest", """select recipient_state, pricing_zone from (
                  select *, row_number() over (partition by recipient_state
                                               order by n desc, pricing_zone asc) as rn
                  from zkk) t where rn = 1"""),
    ("zl", """select pricing_zone, cast(pricing_zone as varchar) || '-['
               || string_agg('''' || recipient_state || '''', ', ' ORDER BY recipient_state)
               || ']' as zone_state from zbest group by 1"""),
    ("zones", "select b.pricing_zone, b.recipient_state, zl.zone_state from zbest b "
              "join zl on b.pricing_zone = zl.pricing_zone"),
]


@register("q17_zone_lookup", with_views(["fedex"], "select * from zones", ZONE_CTES))
def q17_zone_lookup(spark, sf_dir):
    z = shipping.zone_lookup(tables(spark, sf_dir).fedex)
    return z.select("pricing_zone", "recipient_state", "zone_state")


Q18_CTE = ("q18", """select flags.*, zones.zone_state from flags
  join zones on flags.customer_state = zones.recipient_state
  where flags.actual_freight_expense is not null""")
Q18_OUT = ("transaction_id, transaction_date, customer_last_name, customer_state, combined, "
           "weight_total, discount_total, shipping_tiers, positive_negative, discount, "
           "shipping_discount, zone_state, "
           + ", ".join(f"cast({c} as double) as {c}" for c in
                       ["product_price_x_quantity", "total_margin_order", "actual_freight_expense",
                        "net_margin"]))


def _q18(spark, sf_dir):
    margins = _margin_table(spark, sf_dir)
    zones = shipping.zone_lookup(tables(spark, sf_dir).fedex)
    return decimals_to_double(shipping.orders_with_zones(margins, zones))


@register("q18_orders_with_zones", with_views(
    Y_VIEWS + ["fedex"], f"select {Q18_OUT} from q18", Y_CTES + MARGIN_CTES + ZONE_CTES + [Q18_CTE]))
def q18_orders_with_zones(spark, sf_dir):
    return _q18(spark, sf_dir)


Q19_BODY = """
select measure, split, floor(v / 100.0) * 100.0 as bin_lo, count(*) as n_rows from (
  select case when shipping_discount = 'No' then 'match' else 'other' end as split,
         'product_price_x_quantity' as measure, cast(product_price_x_quantity as double) as v
  from q18 where weight_total < 45
  union all
  select case when shipping_discount = 'No' then 'match' else 'other' end as split,
         'net_margin' as measure, cast(net_margin as double) as v
  from q18 where weight_total < 45) e
where v is not null group by 1, 2, 3"""


@register("q19_joint_distribution", with_views(
    Y_VIEWS + ["fedex"], Q19_BODY, Y_CTES + MARGIN_CTES + ZONE_CTES + [Q18_CTE]))
def q19_joint_distribution(spark, sf_dir):
    return stats.joint_distribution(_q18(spark, sf_dir))


# ------------------------------------------------------------------ Q20
def _repeat_sql(spec) -> str:
    keys = [c for c, _ in spec]
    key_exprs = ", ".join(f"lower({c}) as {c}" if low else c for c, low in spec)
    not_null = " and ".join(f"{c} is not null" for c in keys)
    klist = ", ".join(keys)
    wide = []
    for lab in ("Pre", "Post"):
        p = lab.lower()
        wide += [f"max(case when pre_post = '{lab}' then n end) as {p}_count",
                 f"max(case when pre_post = '{lab}' then first_date end) as {p}_first_date",
                 f"max(case when pre_post = '{lab}' then last_date end) as {p}_last_date"]
    return with_views(["sales"], f"""
select * from (
  select {klist}, {', '.join(wide)} from (
    select {klist}, pre_post, count(distinct transaction_id) as n,
      max(transaction_date) as last_date, min(transaction_date) as first_date
    from (select {key_exprs}, transaction_id, transaction_date,
            case when transaction_date >= TIMESTAMP '{CUTOVER}' then 'Post' else 'Pre' end as pre_post
          from sales where transaction_date >= TIMESTAMP '1995-01-01') s
    where {not_null}
    group by {klist}, pre_post) g
  group by {klist}) w
where pre_count > 0 and post_count > 0""")


def _repeat_query(key: str):
    spec = customers.REPEAT_KEY_SPECS[key]

    def fn(spark, sf_dir):
        return customers.repeat_customers(_lines(spark, sf_dir), spec, min_year=1995)
    fn.__name__ = f"q20_repeat_customers_{key}"
    return fn


for _key, _spec in customers.REPEAT_KEY_SPECS.items():
    register(f"q20_repeat_customers_{_key}", _repeat_sql(_spec))(_repeat_query(_key))


# ------------------------------------------------------------------ Q21-Q23
@register("q21_ship_log_printout", with_views(Y_VIEWS, f"""
select transaction_id, shipping_first_name || ' ' || shipping_last_name as customer,
 customer_phone, item_code,
 product_normalized, units_total
from y where transaction_date >= TIMESTAMP '{SINCE}'
 and transaction_id is not null
 and transaction_id not in (select order_no from ship_log where order_no is not null)""", Y_CTES))
def q21_ship_log_printout(spark, sf_dir):
    t = tables(spark, sf_dir)
    # orders that have a log row drop out before the lines are joined to anything
    todo = shipping.not_in_ship_log(t.sales, t.ship_log)
    y = enrich.enrich_lines(enrich.prepare_lines(todo, CUTOVER), t.pricing, t.ship_log)
    return shipping.ship_log_printout(y, t.ship_log, SINCE)


TO_UPDATE_SQL = (f"select {', '.join(shipping.LOG_UPDATE_COLUMNS)} from sales "
                 "where transaction_id is not null and transaction_id not in "
                 "(select order_no from ship_log where order_no is not null)")


@register("q22_ship_log_to_update", with_views(["sales", "ship_log"], TO_UPDATE_SQL))
def q22_ship_log_to_update(spark, sf_dir):
    t = tables(spark, sf_dir).planned  # few lines are left: only their columns are joined
    return shipping.ship_log_update(t.sales, t.ship_log)


@register("q22_ship_log_appended", with_views(["sales", "ship_log"], f"""
select order_no as transaction_id, cast(actual_freight_expense as double) as actual_freight_expense
from ship_log
union all by name
{TO_UPDATE_SQL}"""))
def q22_ship_log_appended(spark, sf_dir):
    t = tables(spark, sf_dir)
    return decimals_to_double(shipping.append_to_log(t.ship_log,
                                                     shipping.ship_log_update(t.sales, t.ship_log)))


@register("q22_ship_log_latest", with_views(["sales", "ship_log"], f"""
select {', '.join(shipping.LOG_UPDATE_COLUMNS)}, line_seq from sales
where transaction_id is not null and transaction_id not in
 (select order_no from ship_log where order_no is not null)
order by transaction_id desc, line_seq desc limit 50"""))
def q22_ship_log_latest(spark, sf_dir):
    t = tables(spark, sf_dir)
    todo = shipping.ship_log_update(t.sales, t.ship_log,
                                    (*shipping.LOG_UPDATE_COLUMNS, "line_seq"))
    return shipping.latest_rows(todo, 50, ["transaction_id", "line_seq"])


BILL_SQL = ("cast(date_shipment as date) as date_shipment, "
            "cast(date_delivery as date) as date_delivery, pricing_zone, recipient_state, "
            "tracking_no")


@register("q23_carrier_bill_clean", with_views(["fedex"], f"""
select distinct {BILL_SQL}, cast(date_invoice as date) as date_invoice from fedex"""))
def q23_carrier_bill_clean(spark, sf_dir):
    raw = shipping.carrier_bill_export_form(tables(spark, sf_dir).fedex)
    good, _bad = shipping.clean_carrier_bill(raw)
    return good


@register("s02_carrier_bill_csv", with_views(["fedex"], f"""
select distinct {BILL_SQL}, cast(date_invoice as date) as date_invoice, false as rejected
from fedex where tracking_no not like '%-3'
union all by name
select {BILL_SQL}, null::date as date_invoice, true as rejected
from fedex where tracking_no like '%-3'"""))
def s02_carrier_bill_csv(spark, sf_dir):
    """The carrier bill as two CSV files with their columns in different orders,
    every third parcel with an invoice date that is none: scanned by name, three
    dates parsed, the unusable rows set aside."""
    import uuid
    from ..schemas import CARRIER_BILL_CSV, CARRIER_DATE_RENAMES, CARRIER_OTHER_RENAMES
    from ..session import checkpoint_root
    from ..sources.csv_exports import read_csv_exports, write_csv_export
    bill = shipping.carrier_bill_export_form(tables(spark, sf_dir).fedex)
    no, invoice = (F.col(f"`{c}`") for c in ("Shipment Tracking Number",
                                             "Invoice Date (mm/dd/yyyy)"))
    bill = bill.withColumn("Invoice Date (mm/dd/yyyy)",
                           F.when(no.endswith("-3"), F.lit("pending")).otherwise(invoice))
    base = f"{checkpoint_root(spark).rstrip('/')}/ordercraft-bills/{uuid.uuid4().hex[:12]}"
    cols = bill.columns
    first = F.coalesce(F.col("`Recipient State/Province`") < "J", F.lit(False))
    write_csv_export(bill.filter(first), f"{base}/a", [f"`{c}`" for c in cols])
    write_csv_export(bill.filter(~first), f"{base}/b", [f"`{c}`" for c in reversed(cols)])
    good, bad = shipping.clean_carrier_bill(
        read_csv_exports(spark, f"{base}/*/*.csv", CARRIER_BILL_CSV, keep_source=False))
    renames = {**CARRIER_DATE_RENAMES, **CARRIER_OTHER_RENAMES}
    bad = bad.withColumnsRenamed(renames).withColumns(
        {c: clean.parse_us_date(c) for c in CARRIER_DATE_RENAMES.values()})
    return good.withColumn("rejected", F.lit(False)).unionByName(
        bad.withColumn("rejected", F.lit(True)))


# ------------------------------------------------------------------ B1, B2, Q24
REVIEW_START, REVIEW_END = "1998-01-01", "1999-12-31"


def _bucket_sql(src_where: str, bucket: str, name: str, step: int) -> list[tuple[str, str]]:
    return [
        ("x", f"select * from sales {src_where}"),
        ("a", f"""select {bucket} as {name}, count(distinct transaction_id) as num_of_transactions,
                  coalesce(sum(order_total), 0) as revenue_by_day
                  from x where transaction_date is not null group by 1"""),
        ("cal", f"""select cast(unnest(generate_series(lo, hi, interval {step} day)) as date) as {name}
                    from (select min({name}) as lo, max({name}) as hi from a) b"""),
        ("dense", f"""select cal.{name}, coalesce(a.num_of_transactions, 0) as num_of_transactions,
                      cast(coalesce(a.revenue_by_day, 0) as double) as revenue_by_day
                      from cal left join a on cal.{name} = a.{name}"""),
    ]


DAY_SQL = "cast(transaction_date as date)"
WEEK_SQL = "cast(date_trunc('week', transaction_date) as date) + 6"
REVIEW_WHERE = (f"where transaction_date >= TIMESTAMP '{REVIEW_START}' "
                f"and transaction_date <= TIMESTAMP '{REVIEW_END}'")


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = [("count", "cast(count({c}) as double)"), ("mean", "avg({c})"),
             ("std", "stddev_samp({c})"), ("min", "min({c})"),
             ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
             ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]
    sel = []
    for name, tmpl in parts:
        vals = ", ".join(f"round({tmpl.format(c=f'cast({c} as double)')}, 6) as {c}" for c in cols)
        sel.append(f"select '{name}' as stat, {vals} from {src}")
    return "\nunion all\n".join(sel)


@register("b1_daily_buckets", with_views(["sales"], "select * from dense",
                                         _bucket_sql("", DAY_SQL, "day", 1)))
def b1_daily_buckets(spark, sf_dir):
    return decimals_to_double(calendar.daily_buckets(tables(spark, sf_dir).sales))


@register("b2_weekly_buckets", with_views(["sales"], "select * from dense",
                                          _bucket_sql("", WEEK_SQL, "week_ending", 7)))
def b2_weekly_buckets(spark, sf_dir):
    return decimals_to_double(calendar.weekly_buckets(tables(spark, sf_dir).sales))


def _review(spark, sf_dir):
    return calendar.week_review(tables(spark, sf_dir).sales, REVIEW_START, REVIEW_END)


STAT_COLS = ["num_of_transactions", "revenue_by_day"]

for _part, _bucket, _bname, _step in (("daily", DAY_SQL, "day", 1),
                                      ("weekly", WEEK_SQL, "week_ending", 7)):
    def _details(spark, sf_dir, _p=_part):
        return decimals_to_double(_review(spark, sf_dir)[f"{_p}_details"])

    def _summary(spark, sf_dir, _p=_part):
        s = _review(spark, sf_dir)[f"{_p}_summary"]
        return s.withColumns({c: F.round(c, 6) for c in STAT_COLS})

    _ctes = _bucket_sql(REVIEW_WHERE, _bucket, _bname, _step)
    register(f"q24_week_review_{_part}_details",
             with_views(["sales"], "select * from dense", _ctes))(_details)
    register(f"q24_week_review_{_part}_summary",
             with_views(["sales"], _describe_sql("dense", STAT_COLS), _ctes))(_summary)


# ------------------------------------------------------------------ Q25-Q27
@register("q25_weekly_by_year", with_views(["sales"], f"""
select g.year, g.week_of_year, coalesce(a.unique_transactions, 0) as unique_transactions,
 cast(coalesce(a.sales, 0) as double) as sales
from (select y.year, w.week_of_year from (select distinct year from a) y
      cross join (select distinct week_of_year from a) w) g
left join a on g.year = a.year and g.week_of_year = a.week_of_year""", [
    ("a", f"""select cast(year(transaction_date) as integer) as year,
              cast(weekofyear(transaction_date) as integer) as week_of_year,
              count(distinct transaction_id) as unique_transactions,
              coalesce(sum(order_total), 0) as sales
              from sales where transaction_date >= TIMESTAMP '{START}' group by 1, 2""")]))
def q25_weekly_by_year(spark, sf_dir):
    return decimals_to_double(calendar.weekly_by_year(tables(spark, sf_dir).sales, START))


HOLIDAY_VALUES = ", ".join(f"('{lab}', DATE '{a}', DATE '{b}')"
                           for lab, a, b in calendar.HOLIDAY_WINDOWS_TEST)


@register("q26_holiday_windows", with_views(["sales"], f"""
select w.window_label as year, count(distinct s.transaction_id) as unique_transactions,
 cast(coalesce(sum(s.product_price * s.product_quantity), 0) as double) as sales
from sales s join (select * from (values {HOLIDAY_VALUES}) t(window_label, start_day, end_day)) w
 on s.transaction_date >= cast(w.start_day as timestamp)
 and s.transaction_date <= cast(w.end_day as timestamp)
group by 1"""))
def q26_holiday_windows(spark, sf_dir):
    windows = calendar.windows_table(spark)
    return decimals_to_double(calendar.holiday_comparison(_lines(spark, sf_dir), windows))


@register("q27_product_catalogue", with_views(["sales"], f"""
select product_name, product_code, product_options, product_weight,
 cast(product_price as double) as product_price, max(transaction_date) as max_date
from sales where transaction_date >= TIMESTAMP '{SINCE}'
group by product_name, product_code, product_options, product_weight, product_price"""))
def q27_product_catalogue(spark, sf_dir):
    return decimals_to_double(calendar.product_catalogue(tables(spark, sf_dir).sales, SINCE))


# ------------------------------------------------------------------ Q34
@register("q34_sales_summary", with_views(["sales"], """
select product_options, count(distinct customer_email) as customer_abbr,
 array_to_string(list_sort(list_distinct(list(customer_last_name))), ', ' || chr(10)) as customer,
 cast(coalesce(sum(product_quantity), 0) as bigint) as units_sold,
 max(transaction_date) as date
from sales group by 1"""))
def q34_sales_summary(spark, sf_dir):
    return stats.sales_summary(tables(spark, sf_dir).planned.sales, ["product_options"],
                               "customer_email", "customer_last_name", "product_quantity",
                               "transaction_date")


@register("q34_sales_customers", with_views(["sales"], """
select distinct product_options, customer_last_name from sales
where customer_last_name is not null"""))
def q34_sales_customers(spark, sf_dir):
    return stats.group_values(tables(spark, sf_dir).sales, ["product_options"],
                              "customer_last_name")


# ------------------------------------------------------------------ P2, P12
@register("p02_name_columns", with_views(["sales"], """
select customer_first_name, customer_last_name, shipping_first_name, shipping_last_name,
 product_name from sales"""))
def p02_name_columns(spark, sf_dir):
    return clean.columns_matching(tables(spark, sf_dir).sales, "nam")


# Fixed values for the test tables: product options left out of a report.
EXCLUDED_OPTIONS = ("Brand#1", "Brand#2")


@register("p12_exclude_options", with_views(["sales"], f"""
select transaction_id, line_seq, product_options from sales
where product_options not in ({', '.join(repr(v) for v in EXCLUDED_OPTIONS)})
 or product_options is null"""))
def p12_exclude_options(spark, sf_dir):
    s = tables(spark, sf_dir).sales.select("transaction_id", "line_seq", "product_options")
    return clean.exclude_values(s, "product_options", EXCLUDED_OPTIONS)


# ------------------------------------------------------------------ S1/S2 + C10
def _export_schema():
    from pyspark.sql import types as T
    from ..schemas import MONEY
    return T.StructType([
        T.StructField("pull", T.IntegerType()), T.StructField("transaction_id", T.StringType()),
        T.StructField("line_seq", T.LongType()), T.StructField("transaction_date", T.StringType()),
        T.StructField("customer_last_name", T.StringType()),
        T.StructField("customer_state", T.StringType()),
        T.StructField("shipping_total", T.IntegerType()),
        T.StructField("discount_total", T.IntegerType()), T.StructField("order_total", MONEY),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_options", T.StringType()), T.StructField("product_price", MONEY),
        T.StructField("product_weight", T.IntegerType()),
        T.StructField("product_quantity", T.IntegerType())])


@register("s01_clean_csv_exports", with_views(["raw_pulls"], _q1p_body, _q1p_ctes))
def s01_clean_csv_exports(spark, sf_dir):
    """The overlapping pulls as two CSV exports whose headers list the columns
    in different orders, scanned back by column name (text ids and dates) and
    cleaned: equals the overlapping-pulls cleaning of the typed tables."""
    import uuid
    from ..session import checkpoint_root
    from ..sources.csv_exports import read_csv_exports, write_csv_export
    pulls = tables(spark, sf_dir).raw_pulls
    base = f"{checkpoint_root(spark).rstrip('/')}/ordercraft-exports/{uuid.uuid4().hex[:12]}"
    cols = pulls.columns
    write_csv_export(pulls.filter(F.col("pull") == 1), f"{base}/pull1", cols)
    write_csv_export(pulls.filter(F.col("pull") == 2), f"{base}/pull2", list(reversed(cols)))
    raw = read_csv_exports(spark, f"{base}/*/*.csv", _export_schema())
    return decimals_to_double(clean.clean_order_lines(
        raw, start=START, cutover=CUTOVER, order_tiebreaks=("pull", "line_seq"),
        drop_after_fill=("pull", "line_seq", "source_file")))


# The faults put into the exports, as (order id modulo, remainder).
FAULTS = {"amount": (5, 1), "whole": (7, 2), "word": (43, 5), "date": (47, 7), "blank": (53, 11),
          "surplus": (59, 13), "no_id": (61, 17)}
EXPORT_PARTS = 4
EXPORT_FILE_LINES = 250_000  # lines of an export file, some 40 MB: one task writes a file


def _faulty_exports(spark, sf_dir) -> str:
    """The raw lines as CSV exports without line numbers, in four parts of as many
    files as the lines need, orders whole in one file and the files of the last
    part with their columns reversed; some values written another way
    (``$3.00``, ``2.0``), some unusable (``two``, a date by points, no date at all,
    a field too many, no id). Returns the folder."""
    import uuid
    from ..session import checkpoint_root
    raw = tables(spark, sf_dir).raw_sales
    cols = ["transaction_id", *RAW_FILL_COLS[:6], "category_code", *RAW_FILL_COLS[6:]]
    oid, seq = F.col("transaction_id"), F.col("line_seq")

    def at(fault, *more):
        mod, rest = FAULTS[fault]
        cond = oid % mod == rest
        for m in more:
            cond = cond & m
        return cond

    text = {c: F.col(c).cast("string") for c in cols if c != "category_code"}
    text["category_code"] = F.when(seq == 1, F.concat(F.lit("cat"), oid.cast("string")))
    text["transaction_date"] = (F.when(at("date", seq == 1), F.date_format("transaction_date", "dd.MM.yyyy"))
                                .when(~at("blank"), F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss")))
    text["product_price"] = F.when(at("amount"), F.concat(F.lit("$"), text["product_price"])).otherwise(text["product_price"])
    text["product_quantity"] = (F.when(at("word", seq == 2), F.lit("two"))
                                .when(at("whole"), F.concat(text["product_quantity"], F.lit(".0")))
                                .otherwise(text["product_quantity"]))
    text["transaction_id"] = F.when(~at("no_id", seq == 3), text["transaction_id"])

    def line(names, more):
        return F.concat(F.to_csv(F.struct(*[text[c].alias(c) for c in names])), more)

    files = max(1, -(-raw.count() // (EXPORT_PARTS * EXPORT_FILE_LINES)))  # of a part
    part = F.pmod(oid, F.lit(EXPORT_PARTS)).cast("int")
    more = F.when(at("surplus", seq == 1), F.lit(",more")).otherwise(F.lit(""))
    value = F.when(part == EXPORT_PARTS - 1, line(cols[::-1], more)).otherwise(line(cols, more))
    file = (part * files + F.pmod(F.xxhash64(oid), F.lit(files))).cast("int")
    lines = raw.select(part.alias("part"), file.alias("file"), oid.alias("id"), seq.cast("long").alias("seq"),
                       value.alias("value"))
    of = F.floor(F.col("id") / files).cast("int")
    head = F.when(of == EXPORT_PARTS - 1, F.lit(",".join(cols[::-1]))).otherwise(F.lit(",".join(cols)))
    heads = spark.range(EXPORT_PARTS * files).select(of.alias("part"), F.col("id").cast("int").alias("file"),
                                                     F.lit(-1).cast("long").alias("seq"), head.alias("value"))
    lines = lines.unionByName(heads.withColumn("id", F.lit(None).cast("long")))  # the first line of each file
    base = f"{checkpoint_root(spark).rstrip('/')}/ordercraft-exports/{uuid.uuid4().hex[:12]}"
    lines.repartitionById(EXPORT_PARTS * files, "file") \
         .sortWithinPartitions("part", F.col("id").asc_nulls_first(), "seq").select("part", "value") \
         .write.partitionBy("part").text(base)
    return f"{base}/*/*.txt"


def _faulty_schema():
    from pyspark.sql import types as T
    from ..schemas import MONEY
    kinds = {"shipping_total": T.IntegerType(), "discount_total": T.IntegerType(), "order_total": MONEY,
             "product_price": MONEY, "product_weight": T.IntegerType(), "product_quantity": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in
                         ["transaction_id", *RAW_FILL_COLS, "category_code"]])


def _clean_faulty(spark, sf_dir):
    from ..sources.csv_exports import scan_exports
    found = scan_exports(spark, _faulty_exports(spark, sf_dir), _faulty_schema(), derive=clean.with_keys)
    return clean.clean_exports(found, start=START, cutover=CUTOVER)


def _fault(name, alias="r"):
    return f"{alias}.transaction_id % {FAULTS[name][0]} = {FAULTS[name][1]}"


FAULTY_CTES = [
    ("own", f"""select r.*, case when {_fault('no_id')} and line_seq = 3 then 'no_order_id'
  when {_fault('surplus')} and line_seq = 1 then 'surplus_fields'
  when {_fault('word')} and line_seq = 2 then 'unreadable_value'
  when {_fault('date')} and line_seq = 1 and not ({_fault('blank')}) then 'unreadable_date'
  when {_fault('date')} and line_seq = 1 then 'unreadable_date' end as own_reason from raw_sales r"""),
    ("why", """select *, case when own_reason is not null then own_reason
  when max(case when own_reason <> 'no_order_id' then 1 end) over (partition by transaction_id) = 1
  then 'order_incomplete' end as reason from own"""),
    ("good", f"""select r.* replace (case when {_fault('blank')} then null else transaction_date end as transaction_date),
  case when line_seq = 1 then 'cat' || transaction_id end as category_code from why r where reason is null"""),
    ("filled", f"""select r.*, {', '.join(f'last_value(r.{c} IGNORE NULLS) OVER w AS f_{c}' for c in [*RAW_FILL_COLS[:6], 'category_code'])}
  from good r window w as (partition by r.transaction_id order by r.transaction_date asc nulls last, r.line_seq
  rows between unbounded preceding and current row)"""),
    ("fates", f"""select transaction_id, line_seq, case when f_transaction_date is null then 'no_date'
  when f_transaction_date < TIMESTAMP '{START}' then 'before_start' else 'reported' end as outcome from filled
  union all select case when reason = 'no_order_id' then null else transaction_id end, line_seq, reason from why
  where reason is not null"""),
]


@register("s01_export_account", with_views(["raw_sales"], """
select transaction_id, outcome, count(*) as n_rows from fates group by 1, 2""", FAULTY_CTES))
def s01_export_account(spark, sf_dir):
    """Every row of faulty exports once: per order the rows reported, rejected (by
    reason) or dated before the start."""
    return _clean_faulty(spark, sf_dir).account(["transaction_id"])


@register("s01_export_rejects", with_views(["raw_sales"], """
select case when reason = 'no_order_id' then null else transaction_id end as transaction_id, reason as reject_reason,
 case when reason = 'unreadable_value' then 'product_quantity' else '' end as reject_fields,
 count(*) as n_rows from why where reason is not null group by 1, 2, 3
union all by name
select transaction_id, 'no_date' as reject_reason, '' as reject_fields, count(*) as n_rows
from fates where outcome = 'no_date' group by 1""", FAULTY_CTES))
def s01_export_rejects(spark, sf_dir):
    """The rejects of faulty exports by order, reason and unreadable columns."""
    return _clean_faulty(spark, sf_dir).rejects.groupBy("transaction_id", "reject_reason", "reject_fields") \
        .agg(F.count(F.lit(1)).alias("n_rows"))


FILE_OUT = ["customer_last_name", "customer_state", "category_code"]


@register("q01_clean_file_order", with_views(["raw_sales"], f"""
select transaction_id, f_transaction_date as transaction_date,
 {', '.join(f"coalesce(f_{c}, '-') as {c}" for c in FILE_OUT)},
 coalesce(f_shipping_total, 0) as shipping_total, coalesce(f_discount_total, 0) as discount_total,
 cast(coalesce(f_order_total, 0) as double) as order_total,
 coalesce(regexp_replace(product_name, '\\s+', ' ', 'g'), '-') as product_name,
 coalesce(product_options, '-') as product_options, cast(coalesce(product_price, 0) as double) as product_price,
 coalesce(product_weight, 0) as product_weight, coalesce(product_quantity, 0) as product_quantity,
 cast(coalesce(product_price * product_quantity, 0) as double) as product_price_x_quantity,
 case when f_transaction_date >= TIMESTAMP '{CUTOVER}' then 'Post' else 'Pre' end as pre_post,
 count(*) as export_copies, row_number() over (partition by transaction_id order by min(line_seq)) as place_in_order
from filled where f_transaction_date >= TIMESTAMP '{START}' group by all""".replace("group by all", """group by transaction_id,
 f_transaction_date, f_customer_last_name, f_customer_state, f_category_code, f_shipping_total, f_discount_total,
 f_order_total, product_name, product_options, product_price, product_weight, product_quantity"""), FAULTY_CTES))
def q01_clean_file_order(spark, sf_dir):
    """Exports without line numbers: filled up to category_code in file order, equal
    rows merged; the place of a line within its order follows the files."""
    from pyspark.sql import Window
    lines = decimals_to_double(_clean_faulty(spark, sf_dir).lines)
    place = Window.partitionBy("transaction_id").orderBy("export_line")
    return lines.withColumn("place_in_order", F.row_number().over(place).cast("long")).drop("export_line")


# ------------------------------------------------------------------ P19, F6, J10
POSITIONS = (1, 2, 777, 5000, -3, -1, 10**12)


@register("p19_rows_at_positions", with_views(["sales"], f"""
select transaction_id, line_seq, product_name, position from (
 select transaction_id, line_seq, product_name, row_number() over (order by transaction_id, line_seq) as position,
  count(*) over () as n from sales) s
where {' or '.join(f"position = {p if p > 0 else f'n + 1 - {-p}'}" for p in POSITIONS)}"""))
def p19_rows_at_positions(spark, sf_dir):
    """Rows at positions of the whole table in order, from the start and the end."""
    s = tables(spark, sf_dir).sales.select("transaction_id", "line_seq", "product_name")
    return positions.rows_at(s, POSITIONS, ["transaction_id", "line_seq"])


def _fiscal_sql(grain: str, months: int) -> str:
    end = ("last_day(date_trunc('quarter', transaction_date) + interval 2 month)" if grain == "quarter" else
           "make_date(year(transaction_date + interval 3 month), 9, 30)")
    return f"""select '{grain}' as grain, m.period_end,
 cast(year(m.period_end + interval 3 month) as integer) as fiscal_year,
 cast(quarter(m.period_end + interval 3 month) as integer) as fiscal_quarter,
 last_day(m.period_end - interval 3 month) as three_months_back,
 (select cast(max(transaction_date) as date) from sales) as as_of,
 coalesce(b.n, 0) as num_of_transactions, cast(coalesce(b.revenue, 0) as double) as revenue
from (select last_day(unnest(generate_series(lo, hi, interval {months} month))) as period_end
      from (select date_trunc('month', min({end})) as lo, date_trunc('month', max({end})) as hi from sales) x) m
left join (select cast({end} as date) as period_end, count(distinct transaction_id) as n, sum(order_total) as revenue
      from sales where transaction_date is not null group by 1) b on b.period_end = m.period_end"""


@register("f06_fiscal_periods", with_views(["sales"], "\nunion all\n".join(
    _fiscal_sql(g, m) for g, m in calendar.FISCAL_GRAINS.items())))
def f06_fiscal_periods(spark, sf_dir):
    """Fiscal quarters and years (ending in September) with the data's as-of day."""
    s = tables(spark, sf_dir).sales
    quarters, years = (calendar.fiscal_buckets(s, g) for g in calendar.FISCAL_GRAINS)
    return decimals_to_double(quarters.unionByName(years))


@register("j10_supplier_windows", with_views(["sales"], """
select w.window_label, count(*) as n_lines, count(distinct s.transaction_id) as n_orders
from sales s join (select 's' || s_suppkey as window_label,
   DATE '1995-01-01' + cast(s_suppkey * 37 % 2400 as integer) as start_day,
   DATE '1995-01-01' + cast(s_suppkey * 37 % 2400 + (case when s_suppkey % 10 = 0 then 3650 else s_suppkey % 40 end) as integer) as end_day
  from supplier) w
 on s.transaction_date >= cast(w.start_day as timestamp) and s.transaction_date <= cast(w.end_day as timestamp)
group by 1"""))
def j10_supplier_windows(spark, sf_dir):
    """Lines per date window, with one window per supplier: overlapping ones, of a
    day to ten years, as many as the table has rows."""
    t = tables(spark, sf_dir)
    k = F.col("s_suppkey")
    day = F.lit("1995-01-01").cast("date")
    length = F.when(k % 10 == 0, 3650).otherwise(k % 40)
    w = t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("window_label"),
                          F.date_add(day, (k * 37 % 2400).cast("int")).alias("start_day"),
                          F.date_add(day, (k * 37 % 2400 + length).cast("int")).alias("end_day"))
    lines = t.sales.select("transaction_id", "transaction_date")
    return calendar.count_in_windows(lines, w)
