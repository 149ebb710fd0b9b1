"""Time buckets: orders per day (Q2), dense daily / weekly buckets (B1, B2),
the week review (Q24), weekly sales by year (Q25), holiday windows (Q26) and
the product catalogue (Q27).

Densifying never uses a cross join: the calendar comes from a one-row
aggregate (min and max bucket) exploded with ``sequence``, or from the
distinct sets of both grid axes collected in one aggregate row and exploded.
Both are bounded by the calendar span, not by the data volume. The heavy
work -- the grouped distinct count and sum -- runs as partial/final
aggregates before the small bucket table is joined to its calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import (day_text, fiscal_quarter_end, fiscal_quarter_sep, fiscal_year_end, fiscal_year_sep,
                               iso_week, month_end_months_back, ts_ntz, week_ending_sunday)
from ..session import bounded_side, materialize
from . import stats

# The holiday windows used with the test tables (label, first
# day, last day), from FIXTURES.md.
HOLIDAY_WINDOWS_TEST = (
    ("1998", "1998-11-26", "1998-11-30"),
    ("1999", "1999-11-25", "1999-11-29"),
    ("2000", "2000-11-23", "2000-11-27"),
)


def orders_per_day(lines: DataFrame) -> DataFrame:
    """Q2: distinct orders per calendar day (day as ``YYYY-MM-DD`` text)."""
    return (lines.groupBy(day_text("transaction_date").alias("transaction_date"))
                 .agg(F.count_distinct("transaction_id").alias("num_of_tran")))


def date_range(df: DataFrame, start: str | None, end: str | None,
               date_col: str = "transaction_date", end_inclusive_day: bool = False) -> DataFrame:
    """``start <= d <= end``. ``end`` is midnight (parity), so later times
    on the last day drop unless ``end_inclusive_day`` (then ``d < end + 1 day``)."""
    if start is not None:
        df = df.filter(F.col(date_col) >= ts_ntz(start))
    if end is not None:
        if end_inclusive_day:
            df = df.filter(F.col(date_col) < F.expr(f"TIMESTAMP_NTZ '{end[:10]} 00:00:00'")
                           + F.expr("INTERVAL 1 DAY"))
        else:
            df = df.filter(F.col(date_col) <= ts_ntz(end))
    return df


def _densify_days(buckets: DataFrame, bucket_col: str, step_days: int,
                  fill: dict[str, object]) -> DataFrame:
    """Every bucket from the first to the last (step ``step_days``), missing as ``fill``."""
    bounds = buckets.agg(F.min(bucket_col).alias("lo"), F.max(bucket_col).alias("hi"))
    calendar = bounds.select(F.explode(F.sequence(
        F.col("lo"), F.col("hi"), F.expr(f"INTERVAL {step_days} DAY"))).alias(bucket_col))
    dense = calendar.join(buckets, bucket_col, "left")
    return dense.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def bucket_orders(lines: DataFrame, bucket: Column, bucket_name: str, step_days: int,
                  amount_col: str = "order_total", id_col: str = "transaction_id") -> DataFrame:
    """B1/B2: distinct orders and summed amount per bucket, dense."""
    agg = (lines.filter(F.col("transaction_date").isNotNull())
                .groupBy(bucket.alias(bucket_name))
                .agg(F.count_distinct(id_col).alias("num_of_transactions"),
                     F.coalesce(F.sum(amount_col), F.lit(0)).alias("revenue_by_day")))
    zero = F.lit(0).cast(agg.schema["revenue_by_day"].dataType)
    out = _densify_days(agg, bucket_name, step_days, {"num_of_transactions": 0})
    return out.withColumn("revenue_by_day", F.coalesce(F.col("revenue_by_day"), zero))


def daily_buckets(lines: DataFrame, amount_col: str = "order_total") -> DataFrame:
    """B1: per calendar day, empty days included."""
    return bucket_orders(lines, F.to_date("transaction_date"), "day", 1, amount_col)


def weekly_buckets(lines: DataFrame, amount_col: str = "order_total") -> DataFrame:
    """B2: Monday-Sunday weeks labelled by the Sunday, empty weeks included."""
    return bucket_orders(lines, week_ending_sunday("transaction_date"), "week_ending", 7,
                         amount_col)


def week_review(lines: DataFrame, start: str, end: str, *, end_inclusive_day: bool = False,
                order_grain: bool = False, written: bool = False) -> dict[str, DataFrame]:
    """Q24: daily and weekly buckets with descriptive statistics of each.

    Parity sums ``order_total`` over lines (the value repeats on each line of
    an order); ``order_grain=True`` first keeps one row per order and day.
    ``written`` writes the two bucket tables once, so that a job which writes all
    four results reads the lines once per bucket table.
    """
    x = date_range(lines, start, end, end_inclusive_day=end_inclusive_day)
    if order_grain:
        x = x.dropDuplicates(["transaction_id", "transaction_date", "order_total"])
    daily = daily_buckets(x)
    weekly = weekly_buckets(x)
    if written:
        daily, weekly = materialize(daily, "daily_buckets"), materialize(weekly, "weekly_buckets")
    cols = ["num_of_transactions", "revenue_by_day"]
    return {
        "daily_summary": stats.describe(daily, cols, digits=None),
        "daily_details": daily,
        "weekly_summary": stats.describe(weekly, cols, digits=None),
        "weekly_details": weekly,
    }


def weekly_by_year(lines: DataFrame, start: str, amount_col: str = "order_total",
                   order_grain: bool = False) -> DataFrame:
    """Q25: distinct orders and sales per (year, ISO week), on the full grid
    of years seen x weeks seen, missing cells as 0.

    Parity sums ``amount_col`` over lines (D12); ``order_grain=True`` keeps one
    row per order and date first, so an order-level total counts once."""
    p = lines.filter(F.col("transaction_date") >= ts_ntz(start))
    if order_grain:
        p = p.dropDuplicates(["transaction_id", "transaction_date", amount_col])
    agg = (p.groupBy(F.year("transaction_date").alias("year"),
                     iso_week("transaction_date").alias("week_of_year"))
            .agg(F.count_distinct("transaction_id").alias("unique_transactions"),
                 F.coalesce(F.sum(amount_col), F.lit(0)).alias("sales")))
    axes = agg.agg(F.collect_set("year").alias("ys"), F.collect_set("week_of_year").alias("ws"))
    grid = (axes.select(F.explode("ys").alias("year"), "ws")
                .select("year", F.explode("ws").alias("week_of_year")))
    zero = F.lit(0).cast(agg.schema["sales"].dataType)
    return (grid.join(agg, ["year", "week_of_year"], "left")
                .withColumns({"unique_transactions":
                              F.coalesce(F.col("unique_transactions"), F.lit(0).cast("long")),
                              "sales": F.coalesce(F.col("sales"), zero)}))


def windows_table(spark: SparkSession,
                  windows: Sequence[tuple[str, str, str]] = HOLIDAY_WINDOWS_TEST) -> DataFrame:
    """A small (label, start, end) table of named date windows."""
    schema = T.StructType([T.StructField("window_label", T.StringType()),
                           T.StructField("start_day", T.StringType()),
                           T.StructField("end_day", T.StringType())])
    return (spark.createDataFrame(list(windows), schema)
                 .select("window_label", F.to_date("start_day").alias("start_day"),
                         F.to_date("end_day").alias("end_day")))


WINDOW_GRAIN_DAYS = 32


def in_windows(lines: DataFrame, windows: DataFrame,
               date_col: str = "transaction_date", grain_days: int = WINDOW_GRAIN_DAYS,
               keep: Sequence[str] = ()) -> DataFrame:
    """Label lines by the named windows (``start <= d <= end``, end at
    midnight) they fall in; a line in several windows comes once for each. The
    columns ``keep`` of the windows come with the label.

    Windows are cut into bins of ``grain_days``, so lines meet them in an
    equality join on the bin instead of a range join. The binned windows are
    written and measured: broadcast while small, a shuffle join (which AQE can
    split) otherwise. A filter on the overall span reaches the scan.
    """
    def bin_of(c):
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(grain_days))

    binned = windows.filter(F.col("start_day") <= F.col("end_day")).select(
        *dict.fromkeys(["window_label", "start_day", "end_day", *keep]),
        F.explode(F.sequence(bin_of(F.col("start_day")), bin_of(F.col("end_day")))).alias("__bin"))
    span = windows.agg(F.min("start_day"), F.max("end_day")).first()
    x = lines
    if span is not None and span[0] is not None:
        x = x.filter((F.col(date_col) >= ts_ntz(span[0]))
                     & (F.col(date_col) <= ts_ntz(span[1])))
    x = x.withColumn("__bin", bin_of(F.to_date(date_col)))
    j = x.join(bounded_side(binned, "windows"), "__bin")
    j = j.filter((F.col(date_col) >= F.col("start_day").cast("timestamp_ntz"))
                 & (F.col(date_col) <= F.col("end_day").cast("timestamp_ntz")))
    return j.drop("__bin", *[c for c in ("start_day", "end_day") if c not in keep])


def order_day_cells(lines: DataFrame, id_col: str = "transaction_id",
                    date_col: str = "transaction_date") -> DataFrame:
    """The lines as cells (``date_col``, ``prev_at``, ``n_lines``, ``n_orders``), from
    which lines and distinct orders of any date window are sums: ``n_lines`` lines
    of a time (``prev_at`` null), and ``n_orders`` orders with a line then whose
    line before lies at ``prev_at`` (null: none). An order counts once in a window
    that holds several of its times: at the one whose ``prev_at`` lies before the
    window. Windows begin and end at midnight, so times between two midnights are
    one (noon): a calendar has two cells a day, however many lines there are, and
    further ones only for orders with several times."""
    day = F.to_date(date_col).cast("timestamp_ntz")
    at = F.when(F.col(date_col) == day, day).otherwise(day + F.expr("INTERVAL 12 HOURS"))
    rows = lines.select(F.col(id_col).alias("__id"), at.alias(date_col)).filter(F.col(date_col).isNotNull())
    none = F.lit(None).cast("timestamp_ntz")
    counted = rows.groupBy(date_col).agg(F.count(F.lit(1)).alias("n_lines")).select(
        date_col, none.alias("prev_at"), "n_lines", F.lit(0).cast("long").alias("n_orders"))
    times = rows.filter(F.col("__id").isNotNull()).groupBy("__id").agg(
        F.sort_array(F.collect_set(date_col)).alias("__at"))  # at most two a day
    steps = times.select("__at", F.posexplode("__at").alias("__i", date_col)).select(
        date_col, F.when(F.col("__i") > 0, F.element_at("__at", F.greatest("__i", F.lit(1)))).alias("prev_at"))
    firsts = steps.groupBy(date_col, "prev_at").agg(F.count(F.lit(1)).alias("n_orders"))
    return counted.unionByName(firsts.withColumn("n_lines", F.lit(0).cast("long")))


def count_in_windows(lines: DataFrame, windows: DataFrame, id_col: str = "transaction_id",
                     date_col: str = "transaction_date") -> DataFrame:
    """Lines (``n_lines``) and distinct orders (``n_orders``) per window label,
    for any number of overlapping windows. Only day cells meet the windows, so the
    work per window is bounded by the calendar, not by the lines in it. A label
    that the table has several times (with one span) counts its lines as often
    and its orders once."""
    spans = windows.groupBy("window_label", "start_day", "end_day").agg(F.count(F.lit(1)).alias("__copies"))
    cells = in_windows(order_day_cells(lines, id_col, date_col), spans, date_col, keep=("start_day", "__copies"))
    first = F.col("prev_at").isNull() | (F.col("prev_at") < F.col("start_day").cast("timestamp_ntz"))
    return cells.groupBy("window_label").agg(
        F.sum(F.col("n_lines") * F.col("__copies")).alias("n_lines"),
        F.sum(F.when(first, F.col("n_orders")).otherwise(0)).alias("n_orders"))


FISCAL_GRAINS = {"quarter": 3, "year": 12}


def as_of(df: DataFrame, date_col: str = "transaction_date") -> str | None:
    """the data's own as-of day (its latest date) as ``YYYY-MM-DD``."""
    return df.agg(F.date_format(F.max(date_col), "yyyy-MM-dd")).first()[0]


def fiscal_buckets(lines: DataFrame, grain: str, amount_col: str = "order_total",
                   id_col: str = "transaction_id", date_col: str = "transaction_date") -> DataFrame:
    """distinct orders and amount per fiscal quarter or year (years end in
    September), labelled by the period's last day, empty periods included, with
    the month end three months before it and the data's as-of day."""
    months = FISCAL_GRAINS[grain]
    end = fiscal_quarter_end(date_col) if grain == "quarter" else fiscal_year_end(date_col)
    rows = lines.filter(F.col(date_col).isNotNull())
    agg = rows.groupBy(end.alias("period_end")).agg(
        F.count_distinct(id_col).alias("num_of_transactions"),
        F.coalesce(F.sum(amount_col), F.lit(0)).alias("revenue"), F.max(date_col).alias("__last"))
    bounds = agg.agg(F.min("period_end").alias("lo"), F.max("period_end").alias("hi"),
                     F.to_date(F.max("__last")).alias("as_of"))
    axis = bounds.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"),
                                              F.expr(f"INTERVAL {months} MONTH"))).alias("__m"), "as_of")
    axis = axis.select(F.last_day("__m").alias("period_end"), "as_of")
    zero = F.lit(0).cast(agg.schema["revenue"].dataType)
    return axis.join(agg.drop("__last"), "period_end", "left").select(
        F.lit(grain).alias("grain"), "period_end", fiscal_year_sep("period_end").alias("fiscal_year"),
        fiscal_quarter_sep("period_end").alias("fiscal_quarter"),
        month_end_months_back("period_end").alias("three_months_back"), "as_of",
        F.coalesce("num_of_transactions", F.lit(0).cast("long")).alias("num_of_transactions"),
        F.coalesce("revenue", zero).alias("revenue"))


def holiday_comparison(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Q26: distinct orders and sales per holiday window."""
    return (in_windows(lines, windows)
            .groupBy(F.col("window_label").alias("year"))
            .agg(F.count_distinct("transaction_id").alias("unique_transactions"),
                 F.coalesce(F.sum("product_price_x_quantity"), F.lit(0)).alias("sales")))


def product_catalogue(lines: DataFrame, since: str,
                      keys: Sequence[str] = ("product_name", "product_code", "product_options",
                                             "product_weight", "product_price")) -> DataFrame:
    """Q27: every product sold since ``since`` with its last sale date."""
    return (lines.filter(F.col("transaction_date") >= ts_ntz(since))
                 .groupBy(*keys).agg(F.max("transaction_date").alias("max_date"))
                 .orderBy(keys[0]))  # L7


__all__ = ["orders_per_day", "date_range", "bucket_orders", "daily_buckets", "weekly_buckets",
           "week_review", "weekly_by_year", "windows_table", "in_windows", "order_day_cells", "count_in_windows",
           "holiday_comparison", "product_catalogue", "as_of", "fiscal_buckets"]
