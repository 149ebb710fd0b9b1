"""Queries that must not grow faster than their input: their results on own rows,
and what their plans leave out."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ordercraft.operators import calendar, customers, stats, subtotals
from ordercraft.operators.fill import forward_fill
from ordercraft.plans import QUERIES, line_queries
from ordercraft.sources import fixtures

D = dt.datetime


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Own base tables: 60 orders of one to nine lines, a part without lines, an
    order without a log entry (every seventh)."""
    base, draw = str(tmp_path_factory.mktemp("shop")), random.Random(3)
    day = [D(1995, 1, 1) + dt.timedelta(days=40 * i) for i in range(60)]
    lines = [(o, 1 + i % 4, 1 + draw.randrange(9), 1 + draw.randrange(3), float(draw.randrange(1, 50)), 1.5 * i, 0.1, 0.0,
              day[o - 1] + dt.timedelta(days=5), draw.choice("ARN"), draw.choice("OF"))
             for o in range(1, 61) for i in range(1 + o % 9)]
    data = {
        "nation": ([(i, f"NATION_{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"Customer {i}", i % 3) for i in range(1, 8)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(i, f"S{i}") for i in (1, 2, 2, 3, 10, 20)], "s_suppkey long, s_name string"),
        "part": ([(i, f"part  {i}", f"Brand {i % 3}", f"T{i % 2}", i, 10.0 + i) for i in range(1, 11)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(o, 1 + o % 7, 100.0 * o, day[o - 1], "1-URGENT") for o in range(1, 61)],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                            "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz, "
                            "l_returnflag string, l_linestatus string")}
    for name, (values, schema) in data.items():
        spark.createDataFrame(values, schema).write.parquet(f"{base}/{name}.parquet")
    return base


def test_window_counts_against_plain_counting(spark):
    draw = random.Random(1)
    base = D(2020, 1, 1)
    lines = [(draw.choice([1, 2, 3, 4, None]), base + dt.timedelta(hours=12 * draw.randrange(40))) for _ in range(60)]
    lines += [(1, None)] + lines[:9]
    spans = {f"w{i}": (s := draw.randrange(20), s + draw.randrange(-1, 15)) for i in range(40)}
    windows = [(k, (base + dt.timedelta(days=a)).date(), (base + dt.timedelta(days=b)).date()) for k, (a, b) in spans.items()]
    windows += windows[:5]  # copies: lines count as often, orders once
    got = calendar.count_in_windows(
        spark.createDataFrame(lines, "transaction_id long, transaction_date timestamp_ntz"),
        spark.createDataFrame(windows, "window_label string, start_day date, end_day date"))
    want = {}
    for k, a, b in windows:
        inside = [i for i, d in lines if d and D.combine(a, dt.time()) <= d <= D.combine(b, dt.time())]
        if inside:
            n, ids = want.get(k, (0, set()))
            want[k] = n + len(inside), ids | {i for i in inside if i is not None}
    assert {r.window_label: (r.n_lines, r.n_orders) for r in got.collect()} == {k: (n, len(i)) for k, (n, i) in want.items()}


def test_windows_meet_day_cells_not_lines(spark):
    lines = spark.range(20_000).select((F.col("id") % 5_000).alias("transaction_id"), F.expr(
        "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 5000 % 3 as int))").alias("transaction_date"))
    cells = calendar.order_day_cells(lines)
    assert cells.filter("prev_at is null").count() == 6  # lines and orders of three days
    assert cells.agg(F.sum("n_lines")).first()[0] == 20_000


def _without_view(spark, shop, name):
    """The rows of a query under a path of its own, for which it writes no whole view."""
    os.symlink(shop, path := f"{shop}-{name}")
    got = sorted(map(repr, QUERIES[name](spark, path).collect()))
    assert not [k for k in fixtures._VIEWS if k[1] == path and k[2] in ("sales", "production")]
    return got


def test_ship_log_update_reads_the_missing_orders_only(spark, shop):
    _without_view(spark, shop, "q22_ship_log_to_update")
    got = QUERIES["q22_ship_log_to_update"](spark, shop)
    want = fixtures.tables(spark, shop).sales.filter("transaction_id % 7 = 0").select(*got.columns)
    assert sorted(rows(got)) == sorted(rows(want)) and want.count() > 0


def test_multi_line_orders_by_their_window(spark, shop):
    _without_view(spark, shop, "q04_multi_line_orders")
    sales = fixtures.tables(spark, shop).sales
    a = customers.multi_line_orders(sales, hot_orders=[])
    b = customers.multi_line_orders(sales, hot_orders=[1])
    assert sorted(rows(a, "transaction_id", "line_seq")) == sorted(rows(b, "transaction_id", "line_seq"))
    odd = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (1, 1), (1, 2), (1, 3), (2, 1)], "transaction_id long, x int")
    assert sorted(rows(customers.multi_line_orders(odd))) == [(1, 1), (1, 2), (1, 3)]


def test_exports_are_as_many_files_as_their_lines_need(spark, shop, monkeypatch):
    whole = {n: sorted(map(repr, QUERIES[n](spark, shop).collect()))
             for n in ("s01_export_rejects", "s01_export_account", "q01_clean_file_order")}
    monkeypatch.setattr(line_queries, "EXPORT_FILE_LINES", 10)
    files = spark.read.text(line_queries._faulty_exports(spark, shop)).inputFiles()
    assert len(files) > 2 * line_queries.EXPORT_PARTS
    sizes = spark.read.text(files).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes < 60  # of some 300 lines
    for n, want in whole.items():
        assert sorted(map(repr, QUERIES[n](spark, shop).collect())) == want


def test_export_keys_are_read_once(spark, shop):
    """Ids and dates are written with the scanned rows: no pass over them reads them again."""
    for n in ("s01_export_rejects", "s01_export_account", "q01_clean_file_order"):
        plan = QUERIES[n](spark, shop)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "gettimestamp" not in plan and "try_to_timestamp" not in plan and "decimal(38,10)" not in plan


def test_keys_of_the_scan_and_of_the_cleaner_agree(spark, tmp_path):
    from pyspark.sql import types as T
    from ordercraft.operators import clean
    from ordercraft.sources.csv_exports import scan_exports
    (tmp_path / "a.csv").write_text("transaction_id,transaction_date,category_code,n\n" + "\n".join([
        "1,2020-05-01,a,1", "1,,,2", "2.0,5/1/2020,a,1", "3,01.05.2020,a,1", "3,,,1", "4,2020-05-01,a,two", "4,,,1",
        "x,2020-05-01,a,1", ",2020-05-01,a,1", "5,,a,1", "6,2001-01-01,a,1", "7,01.05.2020,a,two"]) + "\n")
    schema = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("n", T.IntegerType())])
    kept = scan_exports(spark, str(tmp_path), schema, derive=clean.with_keys)
    later = scan_exports(spark, str(tmp_path), schema)
    assert len(kept.derived) == 3 and not later.derived and kept.lines.columns == later.lines.columns
    for part in ("lines", "rejects", "early"):
        a, b = (getattr(clean.clean_exports(x), part) for x in (kept, later))
        assert a.columns == b.columns and sorted(map(str, rows(a))) == sorted(map(str, rows(b)))
    why = dict(rows(clean.clean_exports(kept).rejects, "export_line", "reject_reason"))
    assert why == {4: "unreadable_date", 5: "order_incomplete", 6: "unreadable_value", 7: "order_incomplete",
                   8: "no_order_id", 9: "no_order_id", 10: "no_date", 12: "unreadable_value"}


def test_plain_numbers_are_read_as_all_others(spark):
    from pyspark.sql import types as T
    from ordercraft.schemas import MONEY
    from ordercraft.sources.csv_exports import _read_exact, read_typed
    texts = ["7", "-7", "+7", "007", "2.0", "2.5", "$3.00", "-$3", "1,234.50", " 8 ", "8.", ".5", "1e2", "", "-", "two", None,
             "999999999", "2147483647", "2147483648", "-2147483648", "999999999999999999", "9223372036854775807",
             "9223372036854775808", "10.005", "10.05", "10.050", "9999999999999999.99", "99999999999999999.99", "\u0667", "7\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in (T.IntegerType(), T.LongType(), MONEY, T.DecimalType(18, 6), T.DoubleType(), T.DateType(), T.StringType()):
        got = df.select("t", read_typed(F.col("t"), kind).alias("a"), _read_exact(F.col("t"), kind).alias("b"))
        assert not [r for r in got.collect() if r.a != r.b]


def test_distinct_counts_level_by_level(spark):
    data = [("a", "x", "p", "u1"), ("a", "x", "q", "u1"), ("a", "y", "p", "u1"), ("a", "y", None, "u2"), ("a", None, "p", "u3"),
            ("b", "x", "p", None), (None, "x", "p", "u4"), ("a", "x", "p", "u1")]
    df = spark.createDataFrame(data, "k1 string, k2 string, k3 string, v string")
    out = subtotals.subtotals(df, "v", ["k1", "k2", "k3"], aggregates={"v": F.count_distinct})
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    t = "[Total]"
    assert set(rows(out)) == {("a", t, t, 3), ("b", t, t, 0), ("a", "x", t, 1), ("a", "y", t, 2), ("b", "x", t, 0),
                              ("a", "x", "p", 1), ("a", "x", "q", 1), ("a", "y", "p", 1), ("b", "x", "p", 0)}


def test_subtotals_of_any_aggregate_write_no_view(spark, shop):
    assert _without_view(spark, shop, "q28_subtotals_any_aggregate")


def test_customer_lists_are_made_distinct_by_rows(spark, shop):
    _without_view(spark, shop, "q34_sales_summary")
    data = [("g", "e1", "Zoë", 2), ("g", "e1", "adam", 1), ("g", "e2", "Zoë", None), ("g", None, None, 1), (None, "e3", "x", 1),
            ("h", None, None, None)]
    df = spark.createDataFrame(data, "g string, e string, n string, q int").withColumn("d", F.lit(1))
    out = stats.sales_summary(df, ["g"], "e", "n", "q", "d")
    assert set(rows(out)) == {("g", 2, "Zoë, \nadam", 4, 1), (None, 1, "x", 1, 1), ("h", 0, "", 0, 1)}
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_order_margins_join_recent_lines_only(spark, shop):
    got = _without_view(spark, shop, "q09_order_summary_margin")
    plan = QUERIES["q09_order_summary_margin"](spark, shop)._jdf.queryExecution().executedPlan().toString()
    assert got and not re.search(r"\bWindow\b", plan)


def test_enriched_lines_move_without_their_orders_columns(spark, shop):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _without_view(spark, shop, "q05_enriched_lines")
        plan = QUERIES["q05_enriched_lines"](spark, shop)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#.*\n\W+(?:\*\(\d+\) )?(.*)", plan.toString())
    lines = [below for key, below in moved if key in ("product_name", "transaction_id")]
    assert len(lines) >= 2 and not [x for x in lines if "customer_email" in x or "coupons_used" in x]


@pytest.mark.parametrize("hot", [[], [1]])
def test_lines_and_orders_apart_give_the_same_enriched_lines(spark, shop, hot):
    from ordercraft.operators import enrich
    t = fixtures.tables(spark, shop)
    heads = t.sale_heads.unionByName(t.sale_heads.filter("transaction_id % 5 = 0"))  # an order that comes twice
    heads = heads.filter("transaction_id % 11 > 0")  # lines without an order
    log = t.ship_log.unionByName(t.ship_log.filter("order_no % 3 = 0"))
    pricing = t.pricing.unionByName(t.pricing.filter("product_weight % 2 = 0"))
    sales = t.sale_lines.join(heads, "transaction_id")
    once = fixtures.tables(spark, shop).sales
    assert sorted(map(str, rows(t.sale_lines.join(t.sale_heads, "transaction_id"), *once.columns))) == sorted(map(str, rows(once)))
    want = enrich.enrich_lines(sales, pricing, log, hot_orders=[])
    got = enrich.enrich_lines(t.sale_lines, pricing, log, hot_orders=hot, heads=heads)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(str, rows(got, *want.columns))) == sorted(map(str, rows(want))) and want.count() > t.sale_lines.count()


def test_numbering_writes_its_input_once(spark, monkeypatch):
    from ordercraft.operators import fill
    names = []
    real = fill.materialize
    monkeypatch.setattr(fill, "materialize", lambda df, name: names.append(name) or real(df, name))
    df = spark.createDataFrame([(1, D(2020, 1, 1), "a", 1), (1, None, None, 2), (1, None, None, 3)],
                               "id long, date timestamp_ntz, x string, line_seq long")
    out = forward_fill(df, "id", "date", ["line_seq"], ["date", "x"], hot_keys="all", chunk_rows=2)
    assert sorted(rows(out, "line_seq", "x")) == [(1, "a"), (2, "a"), (3, "a")]
    assert names.count("numbered_ranges") == 1 and "hot_rows" not in names


def test_chunked_fill_moves_the_columns_of_its_result_only(spark, shop, monkeypatch):
    from ordercraft.operators import fill
    written = {}
    real = fill.materialize
    monkeypatch.setattr(fill, "materialize", lambda df, name: written.setdefault(name, df) and real(df, name))
    os.symlink(shop, path := f"{shop}-c03")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(repr, QUERIES["c03_forward_fill_chunked"](spark, path).collect()))
        plan = written["fill_chunks"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    assert got == sorted(map(repr, QUERIES["c03_forward_fill"](spark, shop).collect())) and got
    assert not [k for k in fixtures._VIEWS if k[1] == path and k[2] == "raw_sales"]
    assert not [c for df in written.values() for c in df.columns if c.startswith("product_")]
    # the rows go to their local numbering and stay there for the shift
    moved = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", plan)
    assert len(moved) == 4 and not [x for x in moved if "coalesce" in x]  # theirs, the counts twice, the shift


def test_retail_packaging_writes_no_view(spark, shop):
    got = _without_view(spark, shop, "q31_packaging_used_retail")
    assert len(got) == fixtures.tables(spark, shop).production.count()
