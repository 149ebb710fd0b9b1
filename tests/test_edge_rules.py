"""Edge rules on inline rows (FIXTURES.md section 2)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from ordercraft.functions import dates, text
from ordercraft.operators import (calendar, clean, customers, orders, packaging, shipping,
                                  stats, subtotals)
from ordercraft.operators.fill import forward_fill

D = dt.datetime


def test_fill_basic(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), "a", 1), (1, None, None, 2), (2, None, None, 1)],
                               "id long, date timestamp_ntz, x string, line_seq long")
    out = forward_fill(df, "id", "date", ["line_seq"], ["date", "x"])
    got = sorted(rows(out, "id", "line_seq", "x"))
    assert got == [(1, 1, "a"), (1, 2, "a"), (2, 1, None)]


def test_fill_null_id_untouched(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, None, 2), (1, "c", 3)],
                               "id long, x string, line_seq long")
    df = df.withColumn("date", F.lit(None).cast("timestamp_ntz"))
    out = forward_fill(df, "id", "date", ["line_seq"], ["x"])
    assert sorted(rows(out, "line_seq", "x")) == [(1, "a"), (2, None), (3, "c")]
    good, bad = clean.cast_id(df, "id")
    assert good.count() == 1 and bad.count() == 2


@pytest.mark.parametrize("hot", [(), "all", [1]])
def test_fill_chunked_matches_window(spark, hot):
    data = [(1, D(2020, 1, 1) if i == 0 else None, f"v{i}" if i in (0, 4, 9) else None, i)
            for i in range(12)]
    data += [(2, None, None, 0), (2, D(2020, 2, 1), "w", 1), (2, None, None, 2)]
    df = spark.createDataFrame(data, "id long, date timestamp_ntz, x string, line_seq long")
    expected = sorted(rows(forward_fill(df, "id", "date", ["line_seq"], ["date", "x"]),
                           "id", "line_seq", "date", "x"))
    got = sorted(rows(forward_fill(df, "id", "date", ["line_seq"], ["date", "x"],
                                   hot_keys=hot, chunk_rows=3), "id", "line_seq", "date", "x"))
    assert got == expected
    # id 2: the dated line sorts first (nulls last), so line 0 takes 'w' too
    assert [r[3] for r in expected if r[0] == 2] == ["w", "w", "w"]


def test_fill_product_blank_parity_vs_dedupe_raw(spark):
    # A genuinely blank option takes the value of the line above; with
    # two pulls the two copies of line B are filled differently.
    base = [(1, D(2020, 1, 1), "A", "o1", 1), (1, None, "B", None, 2), (1, None, "C", "o3", 3)]
    pulls = [(p, *r) for p in (1, 2) for r in base]
    # second pull lists the lines in another order
    pulls = pulls[:3] + [(2, 1, D(2020, 1, 1), "A", "o1", 1), (2, 1, None, "C", "o3", 2),
                         (2, 1, None, "B", None, 3)]
    df = spark.createDataFrame(pulls, "pull int, transaction_id long, transaction_date "
                                      "timestamp_ntz, product_name string, opt string, "
                                      "line_seq long")
    kw = dict(start="2019-01-01", cutover="2020-06-01", fill_cols=["transaction_date", "opt"],
              order_tiebreaks=("pull", "line_seq"), drop_after_fill=("pull", "line_seq"))
    parity = clean.clean_order_lines(df, **kw)
    assert parity.count() == 4
    assert sorted(rows(parity.filter("product_name = 'B'"), "opt")) == [("o1",), ("o3",)]
    raw_first = clean.clean_order_lines(df.drop("line_seq").withColumn("line_seq", F.lit(0)),
                                        dedupe_raw=True, **kw)
    assert raw_first.count() == 3


def test_fill_then_filter_keeps_continuation_lines(spark):
    df = spark.createDataFrame([(1, D(2019, 1, 1), 1), (1, None, 2)],
                               "transaction_id long, transaction_date timestamp_ntz, line_seq long")
    df = df.withColumn("product_name", F.concat(F.lit("p"), F.col("line_seq").cast("string")))
    out = clean.clean_order_lines(df, start="2018-01-01")
    assert out.count() == 2


def test_csv_headers_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n9,8\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    from ordercraft.sources.csv_exports import read_csv_exports
    out = read_csv_exports(spark, str(tmp_path / "*.csv"), schema)
    assert sorted(rows(out, "a", "b")) == [(1, 2), (8, 9)]


def test_all_blank_column_is_numeric_zero(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,\n2,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    from ordercraft.sources.csv_exports import read_csv_exports
    out = clean.fill_nulls_by_type(read_csv_exports(spark, str(tmp_path / "*.csv"), schema,
                                                    keep_source=False))
    assert sorted(rows(out, "a", "b")) == [(1, 0.0), (2, 0.0)]


def test_bool_null_needs_own_fill(spark):
    df = spark.createDataFrame([(None, None)], "flag boolean, s string")
    assert rows(clean.fill_nulls_by_type(df)) == [(False, "-")]


def test_whitespace_collapse_python_rules(spark):
    df = spark.createDataFrame([("a\u00a0 b\x1cc ",)], "t string")
    assert rows(df.select(text.collapse_whitespace("t").alias("t"))) == [("a b c ",)]


def test_us_dates_and_quarantine(spark):
    df = spark.createDataFrame([("1/5/2020",), ("01/05/2020",), ("13/45/2020",)], "d string")
    good, bad = clean.parse_dates_with_rejects(df, ["d"])
    assert rows(good) == [(dt.date(2020, 1, 5),), (dt.date(2020, 1, 5),)]
    assert rows(bad) == [("13/45/2020",)]


def test_margin_without_cost(spark):
    y = spark.createDataFrame(
        [(1, D(2021, 1, 1), "L", "S", "P", "n", 1, 1, "o", Decimal("10.00"), None, 1, "x-1 Units")],
        "transaction_id long, transaction_date timestamp_ntz, customer_last_name string, "
        "customer_state string, customer_postal_code string, product_name string, "
        "product_quantity int, product_weight int, product_options string, "
        "product_price decimal(18,2), distributor_price decimal(18,2), line_seq long, "
        "combined string")
    y = y.withColumns({"product_price_x_quantity": F.col("product_price") * 1,
                       "weight_total": F.lit(1)})
    d = orders.order_details(y, "2020-01-01")
    assert rows(d, "margin_per_product") == [(Decimal("10.00"),)]
    t = orders.order_total(y, "2020-01-01")
    assert rows(t, "total_margin_order") == [(Decimal("10.00"),)]


def test_order_margin_all_null_costs_is_zero(spark):
    from ordercraft.operators import enrich
    lines = spark.createDataFrame(
        [(1, "n", "o", Decimal("10.00"), 1, 2, 0, 0, "-")],
        "transaction_id long, product_name string, product_options string, "
        "product_price decimal(18,2), product_weight int, product_quantity int, "
        "shipping_total int, discount_total int, coupons_used string")
    pricing = spark.createDataFrame([], "product_name string, product_options string, "
                                        "product_price decimal(18,2), product_weight int, "
                                        "product_normalized string, distributor_price "
                                        "decimal(18,2), units_normalized long")
    log = spark.createDataFrame([], "order_no long, actual_freight_expense decimal(18,2)")
    y = enrich.enrich_lines(lines, pricing, log)
    assert rows(y, "margin_per_product", "margin_per_order") == [(None, Decimal("0.00"))]


def test_order_flags_nan_rules(spark):
    df = spark.createDataFrame([(None, None, "x"), (0, 0, "No_Shipping_Discount"), (-1, 5, "x")],
                               "net_margin int, discount_total int, shipping_tiers string")
    out = orders.order_flags(df)
    assert rows(out, "positive_negative", "discount", "shipping_discount") == [
        ("Bad", "Yes", "Yes"), ("Good", "No", "No"), ("Bad", "Yes", "Yes")]


def test_shipping_tiers_and_net_margin(spark):
    y = spark.createDataFrame([(1, 0, 0), (1, 5, 0), (2, 5, 0), (3, 10, 0)],
                              "transaction_id long, shipping_total int, discount_total int")
    o = spark.createDataFrame([(1, 20), (2, 20), (3, 20)], "transaction_id long, total_margin_order int")
    log = spark.createDataFrame([(1, 8), (2, 8)], "order_no long, actual_freight_expense int")
    t = orders.net_margin(orders.order_total_ship_log(o, log, y))
    assert sorted(rows(t, "transaction_id", "shipping_tiers", "net_margin")) == [
        (1, "Free_Shipping", 12), (2, "Discounted", 17), (3, "No_Shipping_Discount", None)]


def test_net_margin_add_back(spark):
    df = spark.createDataFrame(
        [("Free_Shipping", 20, -2, 8), ("Discounted", 20, -2, 8),
         ("No_Shipping_Discount", 20, -2, 8), ("No_Shipping_Discount", 20, -2, None)],
        "shipping_tiers string, total_margin_order int, discount_total int, "
        "actual_freight_expense int")
    assert [r[0] for r in rows(orders.net_margin(df), "net_margin")] == [10, 15, 20, None]


def test_coupon_and_label_and_name(spark):
    df = spark.createDataFrame([("SAVE:10", "A", 2), ("x", None, 2), ("-", "B", None)],
                               "c string, n string, q int")
    out = df.select(text.coupon_code("c").alias("c"), text.units_label("n", "q").alias("l"))
    assert rows(out) == [("SAVE", "A-2 Units"), ("", "nan-2 Units"), ("", "B-nan Units")]
    assert rows(spark.range(1).select(text.full_name(F.lit("a"), F.lit(None).cast("string"))
                                      .alias("x"))) == [(None,)]


def test_zone_tie_and_label(spark):
    bill = spark.createDataFrame([("2", "A", "t1"), ("3", "A", "t2"), ("4", "A", "t3"),
                                  ("2", "B", "t4"), (None, "C", "t5"), ("Non Zone", "C", "t6")],
                                 "pricing_zone string, recipient_state string, tracking_no string")
    z = shipping.zone_lookup(bill)
    assert sorted(rows(z, "recipient_state", "pricing_zone", "zone_state")) == [
        ("A", 2, "2-['A', 'B']"), ("B", 2, "2-['A', 'B']")]


def test_week_edges_and_daily_density(spark):
    df = spark.createDataFrame(
        [(1, D(2024, 1, 6, 23)), (1, D(2024, 1, 7, 10)), (2, D(2024, 1, 8)), (3, D(2024, 1, 16, 5))],
        "transaction_id long, transaction_date timestamp_ntz").withColumn("order_total", F.lit(1))
    w = calendar.weekly_buckets(df)
    assert sorted(rows(w, "week_ending", "num_of_transactions")) == [
        (dt.date(2024, 1, 7), 1), (dt.date(2024, 1, 14), 1), (dt.date(2024, 1, 21), 1)]
    assert calendar.daily_buckets(df).count() == 11


def test_week_gap_is_dense(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 2)), (2, D(2024, 1, 20))],
                               "transaction_id long, transaction_date timestamp_ntz") \
        .withColumn("order_total", F.lit(5))
    got = sorted(rows(calendar.weekly_buckets(df), "week_ending", "num_of_transactions"))
    assert got == [(dt.date(2024, 1, 7), 1), (dt.date(2024, 1, 14), 0), (dt.date(2024, 1, 21), 1)]


def test_describe_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    out = dict(rows(stats.describe(df, ["v"], digits=6), "stat", "v"))
    assert out == {"count": 4.0, "mean": 2.5, "std": 1.290994, "min": 1.0, "25%": 1.75,
                   "50%": 2.5, "75%": 3.25, "max": 4.0}
    one = dict(rows(stats.describe(df.limit(1), ["v"]), "stat", "v"))
    assert one["std"] is None
    none = dict(rows(stats.describe(df.filter("v > 9"), ["v"]), "stat", "v"))
    assert none["count"] == 0.0 and none["mean"] is None


def test_end_bound_midnight(spark):
    df = spark.createDataFrame([(D(2024, 1, 6),), (D(2024, 1, 6, 23),)], "transaction_date timestamp_ntz")
    assert calendar.date_range(df, None, "2024-01-06").count() == 1
    assert calendar.date_range(df, None, "2024-01-06", end_inclusive_day=True).count() == 2


def test_subtotal_null_levels(spark):
    df = spark.createDataFrame([("x", "p", "m", 1), ("x", None, "n", 2), ("y", "q", "o", 4)],
                               "a string, b string, c string, v int")
    got = sorted(rows(subtotals.subtotals(df, "v", ["a", "b", "c"])))
    T_ = subtotals.TOTAL_LABEL
    assert got == sorted([("x", T_, T_, 3), ("x", "p", T_, 1), ("x", "p", "m", 1),
                          ("y", T_, T_, 4), ("y", "q", T_, 4), ("y", "q", "o", 4)])


def test_subtotal_one_key_raises(spark):
    df = spark.createDataFrame([("x", 1)], "a string, v int")
    with pytest.raises(ValueError):
        subtotals.subtotals(df, "v", ["a"])
    with pytest.raises(ValueError):
        subtotals.period_filter(df, "qtd", "a", 1)


def test_pct_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (2, 3), (None, 3)], "p long, l long")
    out = subtotals.diff_and_percent(df, ["p", "l"])
    assert rows(out, "difference", "difference_pct") == [(1, None), (0, None), (1, 0.5), (3, None)]


def test_pivot_one_side_and_repeat_two(spark):
    one = spark.createDataFrame([("a", "Pre", 1, D(2020, 1, 1))],
                                "customer_email string, pre_post string, transaction_id long, "
                                "transaction_date timestamp_ntz")
    spec = customers.REPEAT_KEY_SPECS["email"]
    assert customers.repeat_customers(one, spec).count() == 0
    two = spark.createDataFrame([("a", "Pre", 1, D(2020, 1, 1)), ("a", "Post", 2, D(2020, 5, 1)),
                                 ("b", "Pre", 3, D(2020, 1, 2))], one.schema)
    assert rows(customers.repeat_customers(two, spec), "customer_email") == [("a",)]


def test_blank_email_sentinel(spark):
    df = spark.createDataFrame([("-", "Pre", 1, D(2020, 1, 1)), ("-", "Post", 2, D(2020, 5, 1))],
                               "customer_email string, pre_post string, transaction_id long, "
                               "transaction_date timestamp_ntz")
    spec = customers.REPEAT_KEY_SPECS["email"]
    assert customers.repeat_customers(df, spec).count() == 1
    assert customers.repeat_customers(df, spec, exclude_sentinel=True).count() == 0


PACK = [("-", "P01", "II", -5.0), ("B", "P01", "II", -5.0), ("B", "P01", "IR", 5.0),
        ("B", "A1", "IR", 5.0), ("B", "PR1", "IR", 5.0), ("B", "Z1", "IR", 5.0)]


def test_pack_rules(spark):
    df = spark.createDataFrame(PACK, "packaging string, product_num string, transfer_code string, "
                                     "transaction_units double")
    got = [r[0] for r in rows(df.select(packaging.packaging_used_expr("packaging").alias("u")))]
    assert got == [0.0, 5.0, 0.0, 5.0, 5.0, None]
    df2 = df.withColumnRenamed("packaging", "packaging_retail")
    got = [r[0] for r in rows(df2.select(
        packaging.packaging_used_expr("packaging_retail", retail=True).alias("u")))]
    assert got == [0.0, 5.0, 0.0, 30.0, None, None]


def test_inventory_gap(spark):
    inv = spark.createDataFrame(
        [("B", 1, dt.date(2020, 1, 31), 10.0), ("B", 1, dt.date(2020, 2, 29), 4.0),
         ("C", 2, dt.date(2020, 2, 29), 5.0)],
        "packaging string, item_code long, date date, inventory_count double") \
        .withColumn("type", F.lit("packaging"))
    out = packaging.inventory_summary(inv, [dt.date(2020, 1, 31), dt.date(2020, 2, 29)])
    assert rows(out, "packaging", "used_last_month") == [("B", -6.0), ("C", None)]


def test_month_mix_kept(spark):
    df = spark.createDataFrame([(D(2019, 3, 5), D(2020, 7, 1))],
                               "date_transaction timestamp_ntz, date_production timestamp_ntz")
    assert df.filter(packaging.month_mask(3, 2020)).count() == 1


def test_anti_join_drops_null_id(spark):
    lines = spark.createDataFrame([(None,), (5,)], "transaction_id long")
    log = spark.createDataFrame([(1,)], "order_no long")
    assert rows(shipping.not_in_ship_log(lines, log)) == [(5,)]


def test_append_columns_by_name(spark):
    log = spark.createDataFrame([(1, 9.0)], "order_no long, actual_freight_expense double")
    new = spark.createDataFrame([(2, "w")], "transaction_id long, product_name string")
    got = sorted(rows(shipping.append_to_log(log, new),
                      "transaction_id", "actual_freight_expense", "product_name"))
    assert got == [(1, 9.0, None), (2, None, "w")]


def test_iso_week_pairs_with_calendar_year(spark):
    df = spark.createDataFrame([(dt.date(2018, 12, 31),), (dt.date(2021, 1, 1),)], "d date")
    out = df.select(F.year("d"), dates.iso_week("d"))
    assert rows(out) == [(2018, 1), (2021, 53)]


def test_densify_year_week_grid(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 1, 8), 2), (D(2021, 1, 6), 3)],
                               "transaction_date timestamp_ntz, transaction_id long") \
        .withColumn("order_total", F.lit(Decimal("1.00")).cast("decimal(18,2)"))
    out = calendar.weekly_by_year(df, "2019-01-01")
    assert out.count() == 4  # 2 years x 2 weeks seen
    assert rows(out.filter("year = 2021 and week_of_year = 2"), "unique_transactions") == [(0,)]


def test_order_grain_counts_order_total_once(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 2), 5), (1, D(2024, 1, 2), 5), (2, D(2024, 1, 2), 7)],
                               "transaction_id long, transaction_date timestamp_ntz, order_total int")
    parity = calendar.week_review(df, "2024-01-01", "2024-01-31")["daily_details"]
    grain = calendar.week_review(df, "2024-01-01", "2024-01-31", order_grain=True)["daily_details"]
    assert rows(parity, "revenue_by_day") == [(17,)]
    assert rows(grain, "revenue_by_day") == [(12,)]


def test_scale_conf_bounds():
    from ordercraft.session import scale_conf
    small, huge = scale_conf(10 * 2**30), scale_conf(100 * 2**40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(huge["spark.sql.shuffle.partitions"]) == 100_000


def test_bad_zone_is_set_aside_not_fatal(spark):
    bill = spark.createDataFrame([("2", "A", "t1"), ("x9", "A", "t2")],
                                 "pricing_zone string, recipient_state string, tracking_no string")
    good, bad = shipping.zone_rows(bill)
    assert rows(good, "pricing_zone") == [(2,)] and rows(bad, "pricing_zone") == [("x9",)]
    assert shipping.zone_lookup(bill).count() == 1


def test_quoted_csv_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"Order #","Actual Freight Expense"\n1,2.5\n')
    from ordercraft.sources.csv_exports import read_csv_exports
    out = read_csv_exports(spark, str(tmp_path / "*.csv"), keep_source=False)
    assert out.columns == ["Order #", "Actual Freight Expense"]


def test_month_name_and_fiscal_calendar(spark):
    df = spark.createDataFrame([(9, dt.date(2019, 10, 1), dt.date(2019, 9, 30))],
                               "m int, d date, e date")
    out = df.select(dates.month_short_name("m").alias("n"), dates.fiscal_year_sep("d").alias("fy"),
                    dates.month_end_months_back("e", 3).alias("q"))
    assert rows(out) == [("Sep", 2020, dt.date(2019, 6, 30))]


def test_cleaner_collects_rejects(spark):
    df = spark.createDataFrame([("1", "2020-01-05 10:00:00", "a", 1), ("1", None, "b", 2),
                                ("x", "2020-01-05", "c", 1), ("2", "13/45/2020", "d", 1)],
                               "transaction_id string, transaction_date string, "
                               "product_name string, line_seq long")
    rejects = []
    out = clean.clean_order_lines(df, start="2019-01-01", rejects=rejects)
    assert sorted(rows(out, "transaction_id", "product_name")) == [(1, "a"), (1, "b")]
    got = {reason: sorted(r[0] for r in rows(d, "transaction_id")) for reason, d in rejects}
    assert got == {"unparsed_date": ["2"], "no_order_id": ["x"]}


def test_inventory_all_months_pivot(spark):
    inv = spark.createDataFrame(
        [("B", 1, dt.date(2020, 1, 31), 10.0), ("B", 1, dt.date(2020, 2, 29), 4.0),
         ("B", 1, dt.date(2020, 3, 31), 1.0), ("C", 2, dt.date(2020, 1, 31), 5.0)],
        "packaging string, item_code long, date date, inventory_count double") \
        .withColumn("type", F.lit("packaging"))
    full = packaging.inventory_summary(inv)
    assert [c for c in full.columns if c.startswith("2020")] == [
        "2020-01-31", "2020-02-29", "2020-03-31"]
    assert rows(full, "packaging", "used_last_month") == [("B", -3.0), ("C", None)]


def test_chunked_fill_carries_values_from_rows_without_tiebreak(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), "a", None), (1, None, None, 1),
                                (1, None, None, 2)],
                               "id long, date timestamp_ntz, x string, line_seq long")
    expected = sorted(rows(forward_fill(df, "id", "date", ["line_seq"], ["x"]), "line_seq", "x"),
                      key=str)
    got = sorted(rows(forward_fill(df, "id", "date", ["line_seq"], ["x"], hot_keys="all",
                                   chunk_rows=3), "line_seq", "x"), key=str)
    assert got == expected == sorted([(None, "a"), (1, "a"), (2, "a")], key=str)


def test_weekly_by_year_order_grain(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), 5), (1, D(2020, 1, 1), 5)],
                               "transaction_id long, transaction_date timestamp_ntz, order_total int")
    assert rows(calendar.weekly_by_year(df, "2019-01-01"), "sales") == [(10,)]
    assert rows(calendar.weekly_by_year(df, "2019-01-01", order_grain=True), "sales") == [(5,)]
