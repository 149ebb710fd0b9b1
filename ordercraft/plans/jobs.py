"""The reference's three entry points as batch jobs that write their outputs.

* :func:`margin_report` -- enriched lines, the two exception files, and the
  four report tables (summary, margin per order, details, backup).
* :func:`week_review_report` -- daily / weekly buckets and their statistics.
* :func:`ship_log_update` -- append the orders missing from the ship log.

The enriched lines feed every report table, so they are written once as a
table in the shared checkpoint folder and re-read (:func:`materialize`):
one scan and join instead of one per output, and a lost executor recomputes
from that table, not from the raw inputs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar, customers, enrich, orders, packaging, shipping
from ..schemas import PRICE_KEYS, PRICING
from ..session import materialize
from ..sources import ship_log as ship_log_file
from ..sources import sinks

__all__ = ["materialize", "margin_report", "week_review_report", "ship_log_update",
           "packaging_month_end", "repeat_customers_report", "price_table_refresh", "ship_log_printout",
           "carrier_zones"]


PRICE_TABLE = "Product_Pricing"
PRICING_COLUMNS = [f.name for f in PRICING.fields]


def data_day(df: DataFrame, date_col: str = "transaction_date") -> str:
    """As-of day of a report: the data's latest date (today for an empty table)."""
    return calendar.as_of(df, date_col) or dt.date.today().isoformat()


def margin_report(lines: DataFrame, pricing: DataFrame, ship_log: DataFrame, out_dir: str, *,
                  since: str = orders.DEFAULT_SINCE,
                  freight_since: str = enrich.DEFAULT_FREIGHT_SINCE,
                  cutover: str = "2020-03-17", as_of: str | None = None) -> dict[str, str]:
    """Entry 1: margin per order with its exception files."""
    out = out_dir.rstrip("/")
    y = materialize(enrich.enrich_lines(enrich.prepare_lines(lines, cutover), pricing, ship_log),
                    "enriched_lines")
    as_of = as_of or data_day(y)
    written = {
        "missing_products": sinks.write_exceptions(enrich.missing_price_lines(y),
                                                   f"{out}/missing_products"),
        "missing_freight": sinks.write_exceptions(
            enrich.missing_freight_lines(y, freight_since), f"{out}/missing_freight"),
        "lines": sinks.write_order_lines(y, f"{out}/enriched_lines"),
    }
    # contents text in export line order when the lines carry it, else by text
    order_col = "line_seq" if "line_seq" in y.columns else "combined"
    margins = materialize(orders.margin_per_order(y, ship_log, since, order_col=order_col),
                          "margin_per_order")
    book = {
        "Summary": orders.cover_summary(margins),
        "Margin per Order": margins,
        "Details": orders.order_details(y, since),
        "Backup": orders.order_total(y, since, order_col=order_col),
    }
    written.update(sinks.write_named_tables(book, f"{out}/web_orders_as_of_{as_of}"))
    return written


def week_review_report(lines: DataFrame, start: str, end: str, out_dir: str,
                       as_of: str | None = None, **kw) -> dict[str, str]:
    """Entry 2: the four week-review tables."""
    as_of = as_of or data_day(lines)
    tables = calendar.week_review(lines, start, end, written=True, **kw)
    return sinks.write_named_tables(tables, f"{out_dir.rstrip('/')}/summary_data_as_of_{as_of}")


def ship_log_update(lines: DataFrame, ship_log: DataFrame | None, log_path: str) -> DataFrame:
    """Entry 3: append the lines of orders missing from the log (J9 + S13) as one
    batch; returns the rows appended. A broken-off run is finished first, and
    what it appended counts as logged; a repeated run appends nothing."""
    spark = lines.sparkSession
    finished = ship_log_file.finish_batches(spark, log_path)
    if ship_log is None or finished:
        log = ship_log_file.read_log(spark, log_path)
        ship_log = log.select(F.col(f"`{ship_log_file.key_of(log)}`").cast("long").alias("order_no"))
    new = materialize(shipping.ship_log_update(lines, ship_log), "ship_log_new_rows")
    ship_log_file.append(new, log_path)
    return new


def price_table_refresh(lines: DataFrame, prices_dir: str, pricing: DataFrame | None = None) -> dict[str, str]:
    """Q7 + S9: every product combination seen, with its prices and last sale, as
    the next published version of the price table. Without ``pricing`` the prices
    come from the version published last."""
    old = pricing if pricing is not None else sinks.read_published(lines.sparkSession, prices_dir, PRICE_TABLE)
    known = old.select(*[c for c in PRICING_COLUMNS if c in old.columns]).distinct()
    seen = enrich.price_table_candidates(lines, known)
    rest = [c for c in known.columns if c not in seen.columns]
    if rest:  # the other price columns of rows that have a price
        keys = list(PRICE_KEYS)
        extra = known.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])
        seen = seen.join(extra, keys, "left")
    return sinks.write_named_tables({PRICE_TABLE: seen}, prices_dir)


def ship_log_printout(lines: DataFrame, pricing: DataFrame, ship_log: DataFrame, out_dir: str, start: str) -> str:
    """Q21 + S10: the orders since ``start`` still to be typed into the log, as CSV.
    Logged orders drop out before the lines are joined to anything."""
    todo = shipping.not_in_ship_log(lines, ship_log)
    y = enrich.enrich_lines(enrich.prepare_lines(todo), pricing, ship_log)
    return sinks.write_csv(shipping.ship_log_printout(y, ship_log, start), f"{out_dir.rstrip('/')}/to_add")


def carrier_zones(bill: DataFrame, out_dir: str, margins: DataFrame | None = None) -> dict[str, str]:
    """Q23 + Q17 (+ Q18 with ``margins``): the cleaned bill, the zone of each state
    and the orders with their zone; bill rows with an unreadable date or a zone
    that is no number are written beside them."""
    good, bad_dates = shipping.clean_carrier_bill(bill)
    good = materialize(good, "carrier_bill")
    tables = {"bill": good, "rejected_dates": bad_dates, "rejected_zones": shipping.zone_rows(good)[1],
              "zones": materialize(shipping.zone_lookup(good), "zones")}
    if margins is not None:
        tables["orders_with_zones"] = shipping.orders_with_zones(margins, tables["zones"])
    return sinks.write_named_tables(tables, out_dir)


def packaging_month_end(inventory: DataFrame, production: DataFrame, months, month: int,
                        year: int, out_dir: str, as_of: str | None = None) -> dict[str, str]:
    """Entry 4: inventory counts by month with last month's use, and the
    month's packaging use from production paperwork, bulk and retail (S11)."""
    as_of = as_of or data_day(inventory, "date")
    tables = {
        "pack_count": packaging.inventory_summary(inventory, months, "packaging"),
        "retail_count": packaging.inventory_summary(inventory, months, "packaging_retail"),
        "production": packaging.production_usage(production, month, year),
        "production_retail": packaging.production_usage(production, month, year, retail=True),
    }
    return sinks.write_named_tables(tables, f"{out_dir.rstrip('/')}/packaging_as_of_{as_of}")


def repeat_customers_report(lines: DataFrame, out_dir: str, *, min_year: int | None = None,
                            cutover: str = "2020-03-17", as_of: str | None = None
                            ) -> dict[str, str]:
    """Q20: customers seen before and after the cut-over, by e-mail, by last
    name and customer / shipping postal code, and by shipping name and postal
    code -- four tables from one pass over the lines."""
    as_of = as_of or data_day(lines)
    tables = customers.repeat_customers_all(enrich.prepare_lines(lines, cutover), min_year=min_year)
    return sinks.write_named_tables(tables, f"{out_dir.rstrip('/')}/repeat_customers_{as_of}")
