"""Declared schemas for the order-line exports and side tables.

CSV exports are read with these schemas rather than inferred: an all-blank
column would otherwise be typed differently per file (and per engine), which
changes how null fill treats it. Money is DECIMAL(18,2) inside the library so
sums are exact and independent of summation order; it is cast to double only
on output.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
WEIGHT = T.DecimalType(18, 6)  # a join key, so exact

# One row per product in an order, as exported by the web shop. Column
# order matters: the forward fill covers every column up to ``category_code``.
ORDER_LINES_CSV = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_first_name", T.StringType()),
    T.StructField("customer_last_name", T.StringType()),
    T.StructField("customer_state", T.StringType()),
    T.StructField("customer_postal_code", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
    T.StructField("shipping_first_name", T.StringType()),
    T.StructField("shipping_last_name", T.StringType()),
    T.StructField("shipping_address1", T.StringType()),
    T.StructField("shipping_address2", T.StringType()),
    T.StructField("shipping_city", T.StringType()),
    T.StructField("shipping_state", T.StringType()),
    T.StructField("shipping_postal_code", T.StringType()),
    T.StructField("shipping_country", T.StringType()),
    T.StructField("shipping_phone", T.StringType()),
    T.StructField("shipping_total", MONEY),
    T.StructField("discount_total", MONEY),
    T.StructField("order_total", MONEY),
    T.StructField("coupons_used", T.StringType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("product_options", T.StringType()),
    T.StructField("product_price", MONEY),
    T.StructField("product_weight", WEIGHT),
    T.StructField("product_quantity", T.IntegerType()),
    T.StructField("product_total", MONEY),
])

# Price table keyed by the four product columns.
PRICING = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("product_options", T.StringType()),
    T.StructField("product_price", MONEY),
    T.StructField("product_weight", WEIGHT),
    T.StructField("product_normalized", T.StringType()),
    T.StructField("distributor_price", MONEY),
    T.StructField("units_normalized", T.LongType()),
    T.StructField("item_code", T.LongType()),
])

# Ship log (freight per order).
SHIP_LOG = T.StructType([
    T.StructField("order_no", T.LongType()),
    T.StructField("actual_freight_expense", MONEY),
])

# T4: carrier bill as exported; the date columns are M/d/yyyy text.
CARRIER_BILL_CSV = T.StructType([
    T.StructField("Shipment Date(mm/dd/yyyy)", T.StringType()),
    T.StructField("Shipment Delivery Date (mm/dd/yyyy)", T.StringType()),
    T.StructField("Invoice Date (mm/dd/yyyy)", T.StringType()),
    T.StructField("Pricing zone", T.StringType()),
    T.StructField("Recipient State/Province", T.StringType()),
    T.StructField("Shipment Tracking Number", T.StringType()),
])

# The carrier bill's date headers and the names they get.
CARRIER_DATE_RENAMES = {
    "Shipment Date(mm/dd/yyyy)": "date_shipment",
    "Shipment Delivery Date (mm/dd/yyyy)": "date_delivery",
    "Invoice Date (mm/dd/yyyy)": "date_invoice",
}
CARRIER_OTHER_RENAMES = {
    "Pricing zone": "pricing_zone",
    "Recipient State/Province": "recipient_state",
    "Shipment Tracking Number": "tracking_no",
}

# Key of the price table join.
PRICE_KEYS = ("product_name", "product_options", "product_price", "product_weight")
