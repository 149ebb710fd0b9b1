"""Line enrichment (Q5-Q7): price and freight joins, derived line columns.

J1 joins the lines to the price table on four product columns (price as
DECIMAL so equality is exact); J2 joins the ship log on the order id. The
per-order margin total (W2) is a window on the partitioning that the ship-log
join needs anyway; tables with a very large order take an aggregate joined
back instead, which AQE can split across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ts_ntz
from ..functions.text import coupon_code, units_label
from ..schemas import PRICE_KEYS
from ..session import materialize
from .clean import pre_post
from .fill import find_hot_keys

# Fixed values (parameter defaults taken from the reference's reports).
DEFAULT_FREIGHT_SINCE = "2020-01-01"

HOT_ORDER_LINES = 5_000_000  # lines from which an order is too large for one task


def prepare_lines(sales: DataFrame, cutover: str = "2020-03-17") -> DataFrame:
    """Complete order lines -> the cleaner's derived columns (line amount, label)."""
    return sales.withColumns({
        "product_price_x_quantity": F.col("product_price") * F.col("product_quantity"),
        "pre_post": pre_post("transaction_date", cutover),
    })


def join_pricing(lines: DataFrame, pricing: DataFrame) -> DataFrame:
    """Left join on the four product columns (fans out on duplicate keys)."""
    return lines.join(pricing, list(PRICE_KEYS), "left")


def join_ship_log(lines: DataFrame, ship_log: DataFrame) -> DataFrame:
    """Left join of the ship log on order id = ``order_no``."""
    s = ship_log.select("order_no", "actual_freight_expense")
    return (lines.join(s, lines["transaction_id"] == s["order_no"], "left")
                 .drop("order_no"))


def _line_columns(priced: DataFrame) -> DataFrame:
    return priced.withColumns({
        "combined": units_label("product_normalized", "product_quantity"),
        "units_total": F.col("product_quantity") * F.col("units_normalized"),
        "weight_total": F.col("product_quantity") * F.col("product_weight"),
        "coupon_normalized": coupon_code("coupons_used"),
        "margin_per_product": (F.col("product_price") - F.col("distributor_price"))
                              * F.col("product_quantity"),
    })


def _order_rows(ship_log: DataFrame, heads: DataFrame | None) -> tuple[DataFrame, str]:
    """What joins the lines by order id, as ``order_no``, and how: the ship log, or
    the orders' own columns with it (J2 on orders instead of lines, written once)."""
    log = ship_log.select("order_no", "actual_freight_expense")
    if heads is None:
        return log, "left"
    side = heads.join(log, heads["transaction_id"] == log["order_no"], "left").drop("order_no")
    return materialize(side.withColumnRenamed("transaction_id", "order_no"), "orders_with_freight"), "inner"


def enrich_lines(lines: DataFrame, pricing: DataFrame, ship_log: DataFrame,
                 hot_orders: Sequence | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Q5 (combine): priced, freighted lines with margins and order income.

    The total per order (W2) is taken before the ship-log join fans lines out,
    and multiplied by the order's number of log rows, so both joins run once and
    the lines are shuffled once by order: total and log join share that
    partitioning. With very large orders (``hot_orders``; None looks for them by
    a sampled count) the totals are an aggregate that is joined back, which
    combines before its shuffle and lets AQE split the order.

    ``heads``: the columns of the orders (by ``transaction_id``), when ``lines``
    has only its own. They come with the log, after the price join, so that two
    shuffles of the lines need not carry them; lines without an order drop out.
    """
    if hot_orders is None:
        hot_orders = find_hot_keys(lines, "transaction_id", HOT_ORDER_LINES)
    side, how = _order_rows(ship_log, heads)
    priced = join_pricing(lines, pricing)
    if hot_orders:
        y = _line_columns(priced.join(side, priced["transaction_id"] == side["order_no"], how).drop("order_no"))
        per_order = (y.groupBy("transaction_id")
                      .agg(F.coalesce(F.sum("margin_per_product"), F.lit(0))
                           .alias("margin_per_order")))
        y = y.join(per_order, "transaction_id", "left")
    else:
        # of the line's columns only the margin is needed, and shuffled, for the total
        margin = (F.col("product_price") - F.col("distributor_price")) * F.col("product_quantity")
        total = F.sum(margin).over(Window.partitionBy("transaction_id"))
        y = priced.withColumn("margin_per_order", F.when(F.col("transaction_id").isNotNull(),
                                                         F.coalesce(total, F.lit(0))))
        side = side.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("order_no")).cast("int"))
        y = y.join(side, y["transaction_id"] == side["order_no"], how).drop("order_no")
        y = _line_columns(y.withColumn("margin_per_order", F.col("margin_per_order")
                                       * F.coalesce("__n", F.lit(1))).drop("__n"))
    return y.withColumn("income_order",
                        F.col("margin_per_order") + F.col("shipping_total")
                        + F.col("discount_total") - F.col("actual_freight_expense"))


def missing_price_lines(enriched: DataFrame) -> DataFrame:
    """Q6: lines the price table does not cover (or covers without a cost)."""
    return enriched.filter(F.col("product_name").isNull()
                           | F.col("distributor_price").isNull())


def missing_freight_lines(enriched: DataFrame, since: str = DEFAULT_FREIGHT_SINCE) -> DataFrame:
    """Q6: lines since a date whose order has no freight in the ship log."""
    return enriched.filter(F.col("actual_freight_expense").isNull()
                           & (F.col("transaction_date") >= ts_ntz(since)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q6 (D11): keys occurring more than once in a join's right side."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def price_table_candidates(lines: DataFrame, pricing: DataFrame) -> DataFrame:
    """Q7: every product combination seen, with its price columns and last sale.

    Null keys are kept (a combination with no price row shows nulls).
    """
    return (join_pricing(lines, pricing)
            .groupBy("product_normalized", "product_name", "product_options", "product_price",
                     "product_weight", "distributor_price")
            .agg(F.max("transaction_date").alias("max_date")))
