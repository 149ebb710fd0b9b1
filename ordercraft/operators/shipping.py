"""Carrier zones and ship-log maintenance: Q17, Q18, Q21, Q22, Q23.

* The zone lookup (Q17) reduces the carrier bill to one row per state with
  aggregates only (distinct -> count -> ``max_by``); its size is bounded by
  the number of states, so AQE broadcasts it into the order join (Q18).
* "Not yet in the ship log" (Q21, Q22) is a ``left_anti`` join on the id,
  with null ids removed first (an anti join would keep them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ts_ntz
from ..functions.text import full_name, zone_label
from ..schemas import CARRIER_DATE_RENAMES, CARRIER_OTHER_RENAMES
from .clean import parse_dates_with_rejects

# The carrier's marker for shipments outside the zone system.
NON_ZONE = "Non Zone"
# The columns the ship-log update lists for new orders.
LOG_UPDATE_COLUMNS = ("transaction_date", "transaction_id", "shipping_first_name",
                      "shipping_last_name", "shipping_address1", "shipping_city",
                      "shipping_state", "shipping_postal_code", "shipping_phone",
                      "customer_email", "product_name", "product_code", "product_quantity")


def zone_rows(bill: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (zone, state, tracking) bill rows with a numeric zone, and the
    rows whose zone is not a number (kept aside instead of failing the job)."""
    k = (bill.filter(F.col("pricing_zone").isNotNull() & (F.col("pricing_zone") != NON_ZONE))
             .select("pricing_zone", "recipient_state", "tracking_no").distinct()
             .withColumn("__zone", F.col("pricing_zone").try_cast("int")))
    good = k.filter(F.col("__zone").isNotNull()).withColumn("pricing_zone", F.col("__zone"))
    return good.drop("__zone"), k.filter(F.col("__zone").isNull()).drop("__zone")


def zone_lookup(bill: DataFrame) -> DataFrame:
    """Q17: the most frequent pricing zone per recipient state (ties -> lowest
    zone), each zone's sorted state list and its ``2-['NY', 'PA']`` label."""
    k, _rejected = zone_rows(bill)
    counts = k.groupBy("recipient_state", "pricing_zone").agg(F.count(F.lit(1)).alias("n"))
    best = (counts.groupBy("recipient_state")
            .agg(F.max_by("pricing_zone", F.struct(F.col("n"), -F.col("pricing_zone")))
                 .alias("pricing_zone")))
    # one row per state: the zone's state list is a window over this small table
    by_zone = Window.partitionBy("pricing_zone").rowsBetween(Window.unboundedPreceding,
                                                             Window.unboundedFollowing)
    return (best.withColumn("zone_states",
                            F.array_sort(F.collect_list("recipient_state").over(by_zone)))
                .withColumn("zone_state", zone_label("pricing_zone", "zone_states")))


def orders_with_zones(margins: DataFrame, zones: DataFrame) -> DataFrame:
    """Q18: orders with known freight joined to their state's zone label
    (orders in states the bill never saw drop out, as an inner join)."""
    z = zones.select(F.col("recipient_state").alias("__state"), "zone_state")
    known = margins.filter(F.col("actual_freight_expense").isNotNull())
    return (known.join(z, known["customer_state"] == z["__state"], "inner")
                 .drop("__state"))


def not_in_ship_log(lines: DataFrame, log_ids: DataFrame, id_col: str = "transaction_id",
                    log_id_col: str = "order_no") -> DataFrame:
    """Lines whose order id is not in the log (null ids dropped)."""
    ids = log_ids.select(F.col(log_id_col).alias(id_col))
    return lines.filter(F.col(id_col).isNotNull()).join(ids, id_col, "left_anti")


def ship_log_printout(enriched: DataFrame, ship_log: DataFrame, start: str) -> DataFrame:
    """Q21: orders since ``start`` still to be typed into the ship log."""
    todo = not_in_ship_log(enriched.filter(F.col("transaction_date") >= ts_ntz(start)),
                           ship_log)
    return todo.select("transaction_id",
                       full_name("shipping_first_name", "shipping_last_name").alias("customer"),
                       "customer_phone",
                       "item_code", "product_normalized", "units_total")


def ship_log_update(lines: DataFrame, ship_log: DataFrame,
                    columns: Sequence[str] = LOG_UPDATE_COLUMNS) -> DataFrame:
    """Q22: the lines whose order is missing from the log, in log columns."""
    return not_in_ship_log(lines, ship_log).select(*columns)


def append_to_log(ship_log: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The log with the new rows stacked under it by column name."""
    log = ship_log.withColumnRenamed("order_no", "transaction_id")
    return log.unionByName(new_rows, allowMissingColumns=True)


def latest_rows(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """The last ``n`` rows in the given order (a top-n, not a full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def carrier_bill_export_form(bill: DataFrame) -> DataFrame:
    """The carrier bill as its CSV export names and formats it (dates as
    ``M/d/yyyy`` text), for feeding :func:`clean_carrier_bill`."""
    back = {v: k for k, v in {**CARRIER_DATE_RENAMES, **CARRIER_OTHER_RENAMES}.items()}
    cols = []
    for c in bill.columns:
        if c in CARRIER_DATE_RENAMES.values():
            cols.append(F.date_format(F.col(c), "M/d/yyyy").alias(back[c]))
        else:
            cols.append(F.col(c).alias(back.get(c, c)))
    return bill.select(*cols)


def clean_carrier_bill(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q23: parse the M/d/yyyy date columns, rename, dedupe.

    Returns (clean rows, quarantined rows with an unparseable date).
    Sorted by invoice date when the bill has one (L2), then by tracking
    number, so that the rows of one invoice can be ranged over several tasks.
    """
    date_cols = [c for c in CARRIER_DATE_RENAMES if c in raw.columns]
    good, bad = parse_dates_with_rejects(raw, date_cols)
    renames = {k: v for k, v in {**CARRIER_DATE_RENAMES, **CARRIER_OTHER_RENAMES}.items()
               if k in raw.columns}
    out = good.withColumnsRenamed(renames).dropDuplicates()
    if "date_invoice" in out.columns:
        ties = [c for c in ("tracking_no",) if c in out.columns]
        out = out.orderBy("date_invoice", *ties)  # L2
    return out, bad
