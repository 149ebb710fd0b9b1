"""Descriptive statistics (A14), split histograms (A19 / Q19) and the sales
summary spec (A18 / Q34)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sorted_distinct_text

# The statistics rows, in the reference's order.
STAT_NAMES = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max per column.

    One row in -> std null; no rows -> count 0 and the rest null. Quartiles
    are exact (``percentile``), not the approximate ones of ``summary()``;
    this is meant for bucket tables (one row per day or week), not raw lines.
    Values are left as they are, or rounded to ``digits`` decimals.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        parts = [F.count(x).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x),
                 F.percentile(x, 0.25), F.percentile(x, 0.5), F.percentile(x, 0.75), F.max(x)]
        aggs += [(p if digits is None else F.round(p, digits)).alias(f"__{c}_{i}")
                 for i, p in enumerate(parts)]
    one = df.agg(*aggs)
    rows = ", ".join(
        f"'{name}', " + ", ".join(f"`__{c}_{i}`" for c in cols)
        for i, name in enumerate(STAT_NAMES))
    names = ", ".join(f"`{c}`" for c in cols)
    return one.selectExpr(f"stack({len(STAT_NAMES)}, {rows}) as (stat, {names})")


def split_histogram(df: DataFrame, measures: Sequence[str], split_col: str, split_value,
                    bin_width: float) -> DataFrame:
    """Counts per fixed-width bin of each measure, for rows whose
    ``split_col`` equals ``split_value`` ('match') and all others ('other').

    One pass: every row emits one (measure, value) entry per measure.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("measure"),
                                 F.col(m).cast("double").alias("v")) for m in measures])
    split = (F.when(F.col(split_col) == F.lit(split_value), F.lit("match"))
             .otherwise(F.lit("other")))
    e = df.select(split.alias("split"), F.explode(entries).alias("e"))
    e = e.filter(F.col("e.v").isNotNull())
    binned = e.select("split", F.col("e.measure").alias("measure"),
                      (F.floor(F.col("e.v") / F.lit(float(bin_width))) * F.lit(float(bin_width)))
                      .alias("bin_lo"))
    return binned.groupBy("measure", "split", "bin_lo").agg(F.count(F.lit(1)).alias("n_rows"))


def joint_distribution(orders: DataFrame, x: str = "product_price_x_quantity",
                       y: str = "net_margin", hue: str = "shipping_discount",
                       hue_option: str = "No", max_weight: float = 45,
                       bin_width: float = 100.0) -> DataFrame:
    """Q19: the data behind the split joint chart: orders under a weight,
    split by ``hue == hue_option``, binned on both measures."""
    light = orders.filter(F.col("weight_total") < max_weight)
    return split_histogram(light, [x, y], hue, hue_option, bin_width)


def group_values(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """A8 in long form: the distinct non-null values of every group, in order.

    One row per value, so a group may have any number of them; the sort is by
    group and value, so a large group spans many partitions.
    """
    return (df.filter(F.col(value).isNotNull()).select(*group_cols, value).distinct()
              .orderBy(*group_cols, value))


def sales_summary(df: DataFrame, group_cols: Sequence[str], customer_abbr: str,
                  customer: str, units: str, date_col: str) -> DataFrame:
    """Q34 (A18): distinct customers, sorted customer list, units, last date."""
    return (df.groupBy(*group_cols)
              .agg(F.count_distinct(customer_abbr).alias("customer_abbr"),
                   sorted_distinct_text(customer).alias("customer"),
                   F.coalesce(F.sum(units), F.lit(0)).alias("units_sold"),
                   F.max(date_col).alias("date")))
