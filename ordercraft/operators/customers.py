"""Customers: distinct customers (Q3), multi-line orders (Q4) and repeat
customers across the before/after cut-over (Q20).

Repeat customers are found for several customer keys with one generic
function. The reference dedupes an 8-column projection first; that step is
skipped here because every aggregate used (distinct count, min, max) ignores
duplicates, which saves a full shuffle of the lines. Before/after are turned
wide by conditional aggregation over the small grouped table, with the value
list fixed (Pre, Post), so one side missing gives an empty result, not an
error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import year_lower_bound
from ..session import materialize
from .enrich import HOT_ORDER_LINES
from .fill import find_hot_keys

# The four ways of recognising the same customer.
REPEAT_KEY_SPECS: dict[str, tuple[tuple[str, bool], ...]] = {
    "email": (("customer_email", False),),
    "cust_post": (("customer_last_name", True), ("customer_postal_code", False)),
    "ship_post": (("customer_last_name", True), ("shipping_postal_code", False)),
    "ship_name": (("shipping_last_name", True), ("shipping_postal_code", False)),
}
LABELS = ("Pre", "Post")
SENTINEL = "-"


def distinct_customers(lines: DataFrame) -> DataFrame:
    """Q3: distinct (e-mail, first name, last name)."""
    return lines.select("customer_email", "customer_first_name", "customer_last_name").distinct()


def multi_line_orders(lines: DataFrame, min_lines: int = 2,
                      id_col: str = "transaction_id", hot_orders: Sequence | None = None) -> DataFrame:
    """All lines of orders with more than ``min_lines`` lines.

    The sizes are a window count, on the partitioning by order that numbered lines
    have already. With very large orders (``hot_orders``; None looks for them by a
    sampled count) they come from a partial/final aggregate and are applied with
    a semi join, which AQE can split (the window would put such an order in one task).
    """
    if hot_orders is None:
        hot_orders = find_hot_keys(lines, id_col, HOT_ORDER_LINES)
    if not hot_orders:
        size = F.count(F.lit(1)).over(Window.partitionBy(id_col))
        return lines.withColumn("__n", size).filter((F.col("__n") > min_lines)
                                                    & F.col(id_col).isNotNull()).drop("__n")
    big = (lines.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
                .filter(F.col("__n") > min_lines).select(id_col))
    return lines.join(big, id_col, "left_semi")


def _key_cols(spec: Sequence[tuple[str, bool]]) -> list[Column]:
    return [(F.lower(F.col(c)) if lower else F.col(c)).alias(c) for c, lower in spec]


def repeat_customers(lines: DataFrame, spec: Sequence[tuple[str, bool]], *,
                     min_year: int | None = None, exclude_sentinel: bool = False,
                     id_col: str = "transaction_id", date_col: str = "transaction_date",
                     label_col: str = "pre_post") -> DataFrame:
    """Q20 (A13 + U4): customers (by ``spec`` keys) seen both before and after.

    ``spec`` is a list of (column, lower-case?) pairs. ``exclude_sentinel``
    drops keys equal to the blank marker ``'-'`` (all blank e-mails would
    otherwise be one customer).
    """
    keys = [c for c, _ in spec]
    df = lines
    if min_year is not None:
        df = df.filter(year_lower_bound(date_col, min_year))
    df = df.select(*_key_cols(spec), id_col, date_col, label_col)
    df = df.filter(F.col(label_col).isNotNull())
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
        if exclude_sentinel:
            df = df.filter(F.col(k) != SENTINEL)
    g = (df.groupBy(*keys, label_col)
           .agg(F.count_distinct(id_col).alias("n"),
                F.max(date_col).alias("last_date"),
                F.min(date_col).alias("first_date")))
    aggs = []
    for lab in LABELS:
        p = lab.lower()
        sel = F.col(label_col) == lab
        aggs += [F.max(F.when(sel, F.col("n"))).alias(f"{p}_count"),
                 F.max(F.when(sel, F.col("first_date"))).alias(f"{p}_first_date"),
                 F.max(F.when(sel, F.col("last_date"))).alias(f"{p}_last_date")]
    wide = g.groupBy(*keys).agg(*aggs)
    return wide.filter((F.col("pre_count") > 0) & (F.col("post_count") > 0))


def repeat_customers_all(lines: DataFrame,
                         specs: dict[str, Sequence[tuple[str, bool]]] | None = None, *,
                         min_year: int | None = None, id_col: str = "transaction_id",
                         date_col: str = "transaction_date",
                         label_col: str = "pre_post") -> dict[str, DataFrame]:
    """Q20 for several key specs in one pass over the lines.

    Each line emits one (spec, key...) entry per spec; a single partial/final
    aggregate chain then serves every spec (one scan, one set of shuffles
    instead of one per spec). The repeat customers of all specs are written
    once when called and split after that. Returns spec name -> DataFrame with the same
    columns as :func:`repeat_customers`.
    """
    specs = specs or REPEAT_KEY_SPECS
    width = max(len(s) for s in specs.values())
    df = lines
    if min_year is not None:
        df = df.filter(year_lower_bound(date_col, min_year))
    entries = []
    for name, spec in specs.items():
        keys = [(F.lower(F.col(c)) if low else F.col(c)).cast("string") for c, low in spec]
        keys += [F.lit(None).cast("string")] * (width - len(keys))
        ok = F.lit(True)
        for k in keys[:len(spec)]:
            ok = ok & k.isNotNull()
        entries.append(F.when(ok, F.struct(F.lit(name).alias("spec"),
                                           *[k.alias(f"k{i}") for i, k in enumerate(keys)])))
    e = (df.filter(F.col(label_col).isNotNull())
           .select(id_col, date_col, label_col, F.explode(F.array(*entries)).alias("e"))
           .filter(F.col("e").isNotNull())
           .select(F.col("e.*"), id_col, date_col, label_col))
    kcols = ["spec", *[f"k{i}" for i in range(width)]]
    g = (e.groupBy(*kcols, label_col)
          .agg(F.count_distinct(id_col).alias("n"), F.max(date_col).alias("last_date"),
               F.min(date_col).alias("first_date")))
    aggs = []
    for lab in LABELS:
        p, sel = lab.lower(), F.col(label_col) == lab
        aggs += [F.max(F.when(sel, F.col("n"))).alias(f"{p}_count"),
                 F.max(F.when(sel, F.col("first_date"))).alias(f"{p}_first_date"),
                 F.max(F.when(sel, F.col("last_date"))).alias(f"{p}_last_date")]
    wide = materialize(g.groupBy(*kcols).agg(*aggs)
                        .filter((F.col("pre_count") > 0) & (F.col("post_count") > 0)),
                       "repeat_customers")
    out = {}
    for name, spec in specs.items():
        cols = [F.col(f"k{i}").alias(c) for i, (c, _) in enumerate(spec)]
        out[name] = wide.filter(F.col("spec") == name).select(
            *cols, *[f"{lab.lower()}_{m}" for lab in LABELS
                     for m in ("count", "first_date", "last_date")])
    return out
