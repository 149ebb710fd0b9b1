"""Order-level analyses Q8-Q16: details, margin totals, contents text, freight,
shipping tiers, net margin, flags and the cover summary.

Plan notes
----------
* Every aggregate here keys on (or contains) ``transaction_id`` and runs as a
  partial + final hash aggregate, so a very large order is combined map-side
  before the shuffle.
* ``order_total`` (Q11) computes the margin sums and the contents text in ONE
  aggregate over the lines instead of two aggregates and a full outer join.
  The two forms are equal: the detail grouping (Q8) has ``product_quantity``
  as a key, so ``qty * (sum price - sum cost)`` per detail group summed over
  the groups of an order is the sum of ``qty * (price - cost)`` over the
  lines whose nine detail keys are non-null.
* Order-level side tables (freight, discounts, shipping flags) are joined on
  the id; AQE broadcasts them when small and splits skewed partitions when
  not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ts_ntz

# Fixed values (parameter defaults taken from the reference's reports).
DEFAULT_SINCE = "2020-03-23"
ORDER_KEYS = ("transaction_id", "transaction_date", "customer_last_name", "customer_state")
DETAIL_KEYS = ("transaction_id", "transaction_date", "customer_last_name", "customer_state",
               "customer_postal_code", "product_name", "product_quantity", "product_weight",
               "product_options")
TEXT_SEPARATOR = ", \n"
TIER_FREE, TIER_DISCOUNTED, TIER_NONE = "Free_Shipping", "Discounted", "No_Shipping_Discount"
# Shipping charge that marks a tier, and what the net margin adds back per tier.
FREE_CHARGE, DISCOUNTED_CHARGE = 0, 5
TIER_ADD_BACK = {TIER_FREE: 0, TIER_DISCOUNTED: 5, TIER_NONE: 10}
SUMMARY_LABELS = (
    ("product_price_x_quantity", "Total Revenue (not including shipping)"),
    ("total_margin_order", "Margin on Product v. Distributor Cost"),
    ("actual_freight_expense", "Actual Freight Expense"),
    ("net_margin", "Net Margin after Shipping"),
)


def _not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def _zsum(c) -> Column:
    """Sum where an all-null group gives 0 (pandas' sum)."""
    return F.coalesce(F.sum(c), F.lit(0))


def since_filter(df: DataFrame, since: str, date_col: str = "transaction_date") -> DataFrame:
    """Keep rows dated on/after ``since`` (null dates drop)."""
    return df.filter(F.col(date_col) >= ts_ntz(since))


def order_details(y: DataFrame, since: str = DEFAULT_SINCE) -> DataFrame:
    """Q8: one row per order line group (nine keys) with sums and margins."""
    d = (since_filter(y, since).filter(_not_null(DETAIL_KEYS))
         .groupBy(*DETAIL_KEYS)
         .agg(_zsum("product_price_x_quantity").alias("product_price_x_quantity"),
              _zsum("distributor_price").alias("distributor_price"),
              _zsum("product_price").alias("product_price"),
              _zsum("weight_total").alias("weight_total")))
    d = d.withColumn("margin_per_product", F.col("product_price") - F.col("distributor_price"))
    return d.withColumn("total_margin_order",
                        F.col("product_quantity") * F.col("margin_per_product"))


def order_summary_margin(details: DataFrame) -> DataFrame:
    """Q9: details rolled up to the order (first four keys)."""
    return (details.groupBy(*ORDER_KEYS)
            .agg(F.sum("weight_total").alias("weight_total"),
                 F.sum("product_price_x_quantity").alias("product_price_x_quantity"),
                 F.sum("total_margin_order").alias("total_margin_order")))


def _ordered_text(col: str, order_col: str, sep: str = TEXT_SEPARATOR) -> Column:
    """Values joined in line order, duplicates kept."""
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg(`{col}`, '{sep_sql}') WITHIN GROUP (ORDER BY `{order_col}`)")


def order_summary_units(y: DataFrame, since: str = DEFAULT_SINCE,
                        order_col: str = "line_seq") -> DataFrame:
    """Q10: the order's contents as one text, lines in export order."""
    return (since_filter(y, since).filter(_not_null(ORDER_KEYS))
            .groupBy(*ORDER_KEYS)
            .agg(_ordered_text("combined", order_col).alias("combined")))


def order_contents_lines(y: DataFrame, since: str = DEFAULT_SINCE,
                         order_col: str = "line_seq") -> DataFrame:
    """Q10 in long form: the parts of an order's contents, one row each, so an
    order may have any number of lines; sorted by order and line."""
    return (since_filter(y, since).filter(_not_null(ORDER_KEYS))
            .filter(F.col("combined").isNotNull())
            .select(*dict.fromkeys([*ORDER_KEYS, order_col, "combined"]))
            .orderBy(*ORDER_KEYS, order_col))


def order_total(y: DataFrame, since: str = DEFAULT_SINCE, order_col: str = "line_seq") -> DataFrame:
    """Q11: contents text + margin totals per order, in a single aggregate."""
    q = _not_null(DETAIL_KEYS)
    line_margin = F.col("product_quantity") * (
        F.coalesce(F.col("product_price"), F.lit(0))
        - F.coalesce(F.col("distributor_price"), F.lit(0)))
    has_detail = F.max(q.cast("int")) == 1

    def detail_sum(c: Column) -> Column:
        return F.when(has_detail, F.coalesce(F.sum(F.when(q, c)), F.lit(0)))

    return (since_filter(y, since).filter(_not_null(ORDER_KEYS))
            .groupBy(*ORDER_KEYS)
            .agg(_ordered_text("combined", order_col).alias("combined"),
                 detail_sum(F.col("weight_total")).alias("weight_total"),
                 detail_sum(F.col("product_price_x_quantity")).alias("product_price_x_quantity"),
                 detail_sum(line_margin).alias("total_margin_order")))


def order_total_ship_log(orders: DataFrame, ship_log: DataFrame, y: DataFrame) -> DataFrame:
    """Q12 + Q13: orders with freight (distinct log rows), discount and shipping tier.

    Discount pairs and the shipping-tier flags come from one aggregate over the
    lines (one row per order, then exploded back to the distinct discounts), so
    the orders table meets a single order-level side table.
    """
    freight = ship_log.select(F.col("order_no").alias("transaction_id"),
                              "actual_freight_expense").distinct()
    per_order = (y.groupBy("transaction_id")
                  .agg(F.collect_set(F.struct("discount_total")).alias("__discounts"),
                       F.max((F.col("shipping_total") == FREE_CHARGE).cast("int")).alias("__free"),
                       F.max((F.col("shipping_total") == DISCOUNTED_CHARGE).cast("int"))
                        .alias("__disc")))
    side = per_order.select("transaction_id", "__free", "__disc",
                            F.explode_outer("__discounts").alias("__d")) \
                    .select("transaction_id", "__free", "__disc",
                            F.col("__d.discount_total").alias("discount_total"))
    out = (orders.join(freight, "transaction_id", "left")
                 .join(side, "transaction_id", "left"))
    tier = (F.when(F.col("__free") == 1, F.lit(TIER_FREE))
            .when(F.col("__disc") == 1, F.lit(TIER_DISCOUNTED))
            .otherwise(F.lit(TIER_NONE)))
    return out.withColumn("shipping_tiers", tier).drop("__free", "__disc")


def order_master(y: DataFrame, since: str = DEFAULT_SINCE, order_col: str = "line_seq",
                 contents: bool = True) -> DataFrame:
    """Q11-Q13 in one pass over the enriched lines.

    One aggregate per order group over all history: contents text and sums (of
    groups dated since ``since``), distinct discounts and freights, shipping
    flags. An order's groups share what belongs to the order (a window over the
    aggregated rows, on the same partitioning); old groups then drop out. The
    freights are those of the enriched lines, so the log is not joined again.
    ``contents=False`` leaves the text out (its length grows with the order)."""
    q, keyed = _not_null(DETAIL_KEYS), _not_null(ORDER_KEYS)
    recent = F.col("transaction_date") >= ts_ntz(since)
    line_margin = F.col("product_quantity") * (
        F.coalesce(F.col("product_price"), F.lit(0))
        - F.coalesce(F.col("distributor_price"), F.lit(0)))
    has_detail = F.max(q.cast("int")) == 1

    def detail_sum(c: Column) -> Column:
        return F.when(has_detail, F.coalesce(F.sum(F.when(q, c)), F.lit(0)))

    g = y.filter(F.col("transaction_id").isNotNull()).withColumn(
        "__text", F.when(recent & keyed, F.col("combined")))
    text = [_ordered_text("__text", order_col).alias("combined")] if contents else []
    g = g.groupBy(*ORDER_KEYS).agg(
        *text, detail_sum(F.col("weight_total")).alias("weight_total"),
        detail_sum(F.col("product_price_x_quantity")).alias("product_price_x_quantity"),
        detail_sum(line_margin).alias("total_margin_order"),
        F.collect_set(F.struct("discount_total")).alias("__d"),
        F.collect_set(F.struct("actual_freight_expense")).alias("__f"),
        F.max((F.col("shipping_total") == FREE_CHARGE).cast("int")).alias("__free"),
        F.max((F.col("shipping_total") == DISCOUNTED_CHARGE).cast("int")).alias("__disc"))
    order = Window.partitionBy("transaction_id")
    g = g.withColumns({**{c: F.array_distinct(F.flatten(F.collect_list(c).over(order))) for c in ("__d", "__f")},
                       **{c: F.max(c).over(order) for c in ("__free", "__disc")}})
    g = g.filter(recent & keyed)
    tier = (F.when(F.col("__free") == 1, F.lit(TIER_FREE))
            .when(F.col("__disc") == 1, F.lit(TIER_DISCOUNTED))
            .otherwise(F.lit(TIER_NONE)))
    g = g.withColumn("shipping_tiers", tier).withColumn("__d", F.explode("__d")).withColumn("__f", F.explode("__f"))
    return g.withColumns({"actual_freight_expense": F.col("__f.actual_freight_expense"),
                          "discount_total": F.col("__d.discount_total")}).drop("__d", "__f", "__free", "__disc")


def net_margin(df: DataFrame, add_back: dict[str, int] | None = None) -> DataFrame:
    """Q14: margin + discount + tier add-back - freight (null without freight)."""
    add_back = add_back or TIER_ADD_BACK
    bonus = (F.when(F.col("shipping_tiers") == TIER_FREE, F.lit(add_back[TIER_FREE]))
             .when(F.col("shipping_tiers") == TIER_DISCOUNTED, F.lit(add_back[TIER_DISCOUNTED]))
             .otherwise(F.lit(add_back[TIER_NONE])))
    return df.withColumn("net_margin", F.col("total_margin_order") + F.col("discount_total")
                         + bonus - F.col("actual_freight_expense"))


def order_flags(df: DataFrame) -> DataFrame:
    """Q15: Good/Bad margin, discount Yes/No, shipping discount Yes/No.

    A missing net margin is 'Bad' and a missing discount is 'Yes', as the
    reference's comparisons with NaN give.
    """
    return df.withColumns({
        "positive_negative": F.when(F.col("net_margin") >= 0, F.lit("Good"))
                              .otherwise(F.lit("Bad")),
        "discount": F.when(F.col("discount_total") == 0, F.lit("No")).otherwise(F.lit("Yes")),
        "shipping_discount": F.when(F.col("shipping_tiers") == TIER_NONE, F.lit("No"))
                              .otherwise(F.lit("Yes")),
    })


def margin_per_order(y: DataFrame, ship_log: DataFrame | None = None, since: str = DEFAULT_SINCE,
                     order_col: str = "line_seq", contents: bool = True) -> DataFrame:
    """Q11 -> Q15 in one plan: the 'margin per order' table. The enriched lines
    carry the log's freights, so ``ship_log`` is not read again."""
    return order_flags(net_margin(order_master(y, since, order_col, contents)))


def cover_summary(margins: DataFrame) -> DataFrame:
    """Q16: totals over orders with known freight, as (metric, value) rows."""
    known = margins.filter(F.col("actual_freight_expense").isNotNull())
    sums = known.agg(*[_zsum(c).cast("double").alias(c) for c, _ in SUMMARY_LABELS])
    stack = ", ".join(f"'{label}', `{c}`" for c, label in SUMMARY_LABELS)
    return sums.selectExpr(f"stack({len(SUMMARY_LABELS)}, {stack}) as (metric, value)")
