"""Plan checks (no Python in plans, pushdown, one window per fill) and
metamorphic checks that need no oracle."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL, rows
import __spark_entry__ as entry_mod
from ordercraft.operators import calendar, enrich, orders, shipping
from ordercraft.operators.fill import forward_fill
from ordercraft.plans.line_queries import ORDER_LEVEL_FILL
from ordercraft.sources.fixtures import Tables


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(entry_mod.queries()))
def test_no_python_udf_in_plan(spark, name):
    text = plan_text(entry_mod.queries()[name](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                   "MapInPandas", "CartesianProduct"):
        assert marker not in text, f"{marker} in plan of {name}"


def test_date_bound_reaches_scan(spark):
    text = plan_text(entry_mod.queries()["q27_product_catalogue"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(transaction_date" in text


def test_fill_uses_one_window(spark):
    raw = Tables(spark, SF_SMALL).raw_sales
    out = forward_fill(raw, "transaction_id", "transaction_date", ["line_seq"], ORDER_LEVEL_FILL)
    text = plan_text(out.select("transaction_id", *ORDER_LEVEL_FILL))
    # one Window operator for the fill (the fixture's line_seq adds one more)
    assert text.count("Window (") <= 2


def test_fill_is_idempotent(spark):
    raw = Tables(spark, SF_SMALL).raw_sales
    once = forward_fill(raw, "transaction_id", "transaction_date", ["line_seq"], ORDER_LEVEL_FILL)
    twice = forward_fill(once, "transaction_id", "transaction_date", ["line_seq"],
                         ORDER_LEVEL_FILL)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_fill_restores_complete_lines(spark):
    t = Tables(spark, SF_ORACLE)
    filled = forward_fill(t.raw_sales, "transaction_id", "transaction_date", ["line_seq"],
                          ORDER_LEVEL_FILL)
    cols = ["transaction_id", "line_seq", *ORDER_LEVEL_FILL]
    assert filled.select(cols).exceptAll(t.sales.select(cols)).count() == 0


def test_overlapping_pulls_equal_one_pull_when_only_order_fields_blank(spark):
    from ordercraft.operators.clean import clean_order_lines
    t = Tables(spark, SF_ORACLE)
    one = clean_order_lines(t.raw_sales, start="1996-01-01", cutover="1998-01-01")
    two = clean_order_lines(t.raw_pulls, start="1996-01-01", cutover="1998-01-01",
                            order_tiebreaks=("pull", "line_seq"),
                            drop_after_fill=("pull", "line_seq"))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_day_revenue_sums_to_week_revenue(spark):
    s = Tables(spark, SF_SMALL).sales
    d = calendar.daily_buckets(s).agg(F.sum("revenue_by_day")).first()[0]
    w = calendar.weekly_buckets(s).agg(F.sum("revenue_by_day")).first()[0]
    assert d == w


def test_tiers_partition_the_orders(spark):
    t = Tables(spark, SF_SMALL)
    y = enrich.enrich_lines(enrich.prepare_lines(t.sales), t.pricing, t.ship_log)
    tiers = orders.order_total_ship_log(orders.order_total(y, "1990-01-01"), t.ship_log, y)
    n_orders = t.sales.select("transaction_id").distinct().count()
    by_tier = tiers.groupBy("shipping_tiers").count().agg(F.sum("count")).first()[0]
    assert by_tier == n_orders


def test_anti_and_semi_partition_the_lines(spark):
    t = Tables(spark, SF_SMALL)
    anti = shipping.not_in_ship_log(t.sales, t.ship_log).count()
    ids = t.ship_log.select(F.col("order_no").alias("transaction_id"))
    semi = t.sales.join(ids, "transaction_id", "left_semi").count()
    assert anti + semi == t.sales.count()


def test_subtotal_totals_equal_detail_sums(spark):
    from ordercraft.operators.subtotals import TOTAL_LABEL, subtotals
    s = Tables(spark, SF_SMALL).sales
    long = subtotals(s, "product_quantity", ["customer_state", "product_options", "product_name"])
    top = long.filter(F.col("product_options") == TOTAL_LABEL).agg(F.sum("product_quantity"))
    detail = long.filter(F.col("product_name") != TOTAL_LABEL).agg(F.sum("product_quantity"))
    assert top.first()[0] == detail.first()[0] == s.agg(F.sum("product_quantity")).first()[0]


def test_single_pass_order_total_equals_reference_shape(spark):
    t = Tables(spark, SF_SMALL)
    y = enrich.enrich_lines(enrich.prepare_lines(t.sales), t.pricing, t.ship_log)
    one = orders.order_total(y, "1999-01-01").drop("combined")
    ref = orders.order_summary_margin(orders.order_details(y, "1999-01-01"))
    assert one.exceptAll(ref).count() == 0 and ref.exceptAll(one).count() == 0


def test_cover_summary_labels(spark):
    df = entry_mod.queries()["q16_cover_summary"](spark, SF_SMALL)
    assert [r[0] for r in rows(df, "metric")] == [lab for _, lab in orders.SUMMARY_LABELS]


@pytest.mark.parametrize("hot", ["all", "some"])
def test_number_rows_range_path_matches_window(spark, hot):
    from ordercraft.operators.fill import number_rows
    from ordercraft.sources.fixtures import LINE_ORDER
    li = Tables(spark, SF_SMALL).lineitem.select("l_orderkey", *LINE_ORDER)
    plain = number_rows(li, "l_orderkey", LINE_ORDER)
    keys = "all" if hot == "all" else [r[0] for r in li.select("l_orderkey").distinct()
                                       .orderBy("l_orderkey").limit(50).collect()]
    ranged = number_rows(li, "l_orderkey", LINE_ORDER, hot_keys=keys, range_partitions=13)
    assert ranged.count() == plain.count()
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0


def test_bounded_side_broadcasts_only_under_the_limit(spark):
    from ordercraft.session import bounded_side
    s = Tables(spark, SF_SMALL).sales
    ids = s.groupBy("transaction_id").count()
    small = s.join(bounded_side(ids, "ids_small"), "transaction_id")
    assert "BroadcastHashJoin" in plan_text(small) or "broadcast" in plan_text(small).lower()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = s.join(bounded_side(ids, "ids_big", limit_bytes=10), "transaction_id")
        assert "SortMergeJoin" in plan_text(big)
        assert big.count() == small.count() == s.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_hot_order_holding_a_third_of_the_lines(spark):
    """One order holds about a third of all lines: the probe finds it, the
    chunked fill and the range-partitioned numbering give the window results."""
    from ordercraft.operators.fill import find_hot_keys, number_rows
    raw = Tables(spark, SF_SMALL).raw_sales
    hot_id = F.lit(-1).cast("long")
    skewed = raw.select(
        F.when(F.col("transaction_id") % 3 == 0, hot_id).otherwise(F.col("transaction_id"))
         .alias("transaction_id"),
        (F.col("transaction_id") * 100 + F.col("line_seq")).alias("line_seq"),
        *[c for c in raw.columns if c not in ("transaction_id", "line_seq")])
    n_hot = skewed.filter(F.col("transaction_id") == -1).count()
    assert n_hot * 4 > skewed.count()  # the hot order is a large share of all lines
    assert -1 in find_hot_keys(skewed, "transaction_id", min_rows=n_hot // 2, fraction=0.5)
    args = ("transaction_id", "transaction_date", ["line_seq"], ORDER_LEVEL_FILL)
    plain = forward_fill(skewed, *args)
    auto = forward_fill(skewed, *args, hot_keys=None, hot_min_rows=n_hot // 2, chunk_rows=97)
    assert plain.exceptAll(auto).count() == 0 and auto.exceptAll(plain).count() == 0
    order = ["line_seq", "product_name"]
    a = number_rows(skewed, "transaction_id", order, out_col="pos")
    b = number_rows(skewed, "transaction_id", order, out_col="pos", hot_keys=[-1],
                    range_partitions=11)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cleaner_shuffles_the_lines_once(spark):
    text = plan_text(entry_mod.queries()["q01_clean_lines"](spark, SF_SMALL))
    assert text.count("Arguments: hashpartitioning(") == 1


def test_cleaner_rejects_null_ids(spark):
    from ordercraft.operators.clean import clean_order_lines
    import datetime as dt
    df = spark.createDataFrame(
        [(1, None, dt.datetime(2020, 1, 1), "a", 1), (2, None, dt.datetime(2020, 1, 1), "a", 1),
         (1, 7, dt.datetime(2020, 1, 1), "b", 1), (2, 7, dt.datetime(2020, 1, 1), "b", 1)],
        "pull int, transaction_id long, transaction_date timestamp_ntz, product_name string, "
        "line_seq long")
    out = clean_order_lines(df, start="2019-01-01", order_tiebreaks=("pull", "line_seq"),
                            drop_after_fill=("pull", "line_seq"))
    assert rows(out, "transaction_id", "product_name") == [(7, "b")]


def test_repeat_customers_single_pass_equals_separate(spark):
    from ordercraft.operators import customers
    lines = enrich.prepare_lines(Tables(spark, SF_SMALL).sales, cutover="1998-01-01")
    together = customers.repeat_customers_all(lines, min_year=1995)
    for name, spec in customers.REPEAT_KEY_SPECS.items():
        alone = customers.repeat_customers(lines, spec, min_year=1995)
        both = together[name]
        assert both.columns == alone.columns
        assert both.exceptAll(alone).count() == 0 and alone.exceptAll(both).count() == 0


def test_hot_order_with_dated_lines_is_cut_into_bounded_chunks(spark):
    """Half of all lines in one order, every line with its own date or none."""
    from ordercraft.operators.fill import number_chunks
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 10 < 7, F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, int(id))"))
         .alias("d"),
        F.when(F.col("id") % 50 == 0, F.col("id")).alias("x"), F.col("id").alias("seq"))
    chunks = number_chunks(df.filter("k = 7"), "k", "d", ["seq"], 64)
    sizes = [r["count"] for r in chunks.groupBy("k", "__chunk").count().collect()]
    assert max(sizes) == 64 and len(sizes) == -(-(n // 2) // 64)
    args = (df, "k", "d", ["seq"], ["x", "d"])
    want = sorted(map(str, forward_fill(*args).collect()))
    got = forward_fill(*args, hot_keys=None, hot_min_rows=n // 4, chunk_rows=64)
    assert sorted(map(str, got.collect())) == want
    # exports without a line number take the same path
    untied = number_chunks(df.filter("k = 7"), "k", "d", [], 64)
    assert max(r["count"] for r in untied.groupBy("__chunk").count().collect()) == 64


def test_number_rows_keeps_null_keys_on_the_range_path(spark):
    from ordercraft.operators.fill import number_rows
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), "id")
    got = number_rows(df, "k", ["id"], "pos", hot_keys="all", range_partitions=5)
    want = number_rows(df, "k", ["id"], "pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
