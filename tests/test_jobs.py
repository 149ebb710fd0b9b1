"""Jobs and sinks that can be repeated, positions, fiscal periods, interval joins."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_plans import plan_text
import __spark_entry__ as entry_mod
from ordercraft.operators import calendar, enrich, positions, shipping, subtotals
from ordercraft.plans import jobs
from ordercraft.sources import ship_log, sinks
from ordercraft.sources.fixtures import Tables

LINES = [(i, f"2020-05-{i:02d}", k) for i in range(1, 9) for k in range(3)]


def _lines(spark, ids=range(1, 9)):
    rows = [(i, dt.datetime(2020, 5, i), f"p{k}") for i, _, k in LINES if i in ids]
    df = spark.createDataFrame(rows, "transaction_id long, transaction_date timestamp_ntz, product_name string")
    return df.withColumns({c: F.lit("x") for c in shipping.LOG_UPDATE_COLUMNS if c not in df.columns})


@pytest.mark.parametrize("key", ["order_no", "transaction_id"])
def test_ship_log_update_appends_once(spark, tmp_path, key):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 2.5), (2, 3.0)], f"{key} long, actual_freight_expense double").write.parquet(log)
    counts = [jobs.ship_log_update(_lines(spark), None, log).count() for _ in range(3)]
    assert counts == [18, 0, 0]
    rows = ship_log.read_log(spark, log)
    assert [c for c in rows.columns if c in ship_log.KEYS] == [key]
    assert rows.count() == 2 + 18 and rows.where(f"{key} is null").count() == 0


def test_ship_log_update_finishes_a_broken_run(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 2.5)], "order_no long, actual_freight_expense double").write.parquet(log)
    new = shipping.ship_log_update(_lines(spark), spark.range(1, 2).withColumnRenamed("id", "order_no"))
    rows = ship_log.as_log_rows(new, ship_log.read_log(spark, log)).withColumns(
        {ship_log.BATCH: F.lit("k"), ship_log.ROW: F.monotonically_increasing_id()})
    rows.write.parquet(f"{log}_batches/rows/k")
    staged = spark.read.parquet(f"{log}_batches/rows/k")
    # not yet marked complete: no part of the log, and never read
    assert ship_log.finish_batches(spark, log) == [] and ship_log.read_log(spark, log).count() == 1
    ship_log._mark(spark, log, "complete", "k")
    staged.where("order_no <= 3").limit(4).write.mode("append").parquet(log)  # broke off here
    assert jobs.ship_log_update(_lines(spark), None, log).count() == 0
    assert jobs.ship_log_update(_lines(spark), None, log).count() == 0
    got = ship_log.read_log(spark, log).where("batch_key is not null")
    assert got.count() == 21 and got.select("order_no", "product_name").distinct().count() == 21


def test_a_set_is_published_as_a_whole(spark, tmp_path):
    base = str(tmp_path / "set")
    one = spark.range(3)
    sinks.write_named_tables({"a": one, "b b": one}, base)
    broken = one.withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_named_tables({"a": spark.range(9), "b b": broken}, base)
    assert sinks.read_published(spark, base, "a").count() == sinks.read_published(spark, base, "b b").count() == 3
    sinks.write_named_tables({"a": spark.range(9)}, base)
    assert sinks.read_published(spark, base, "a").count() == 9
    assert sinks.read_published(spark, base, "b b").count() == 3
    with pytest.raises(ValueError):
        sinks.read_published(spark, base, "c")


def test_price_refresh_reads_its_last_version(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    base = str(tmp_path / "prices")
    out = jobs.price_table_refresh(t.sales, base, t.pricing)
    first = spark.read.parquet(out[jobs.PRICE_TABLE])
    assert first.count() == entry_mod.queries()["q07_price_table_candidates"](spark, SF_SMALL).count()
    again = jobs.price_table_refresh(t.sales, base)
    assert again != out and spark.read.parquet(again[jobs.PRICE_TABLE]).count() == first.count()
    assert "units_normalized" in sinks.read_published(spark, base, jobs.PRICE_TABLE).columns


def _files(path):
    return {d: [f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")]
            for d in os.listdir(path) if "=" in d}


def test_folders_are_written_in_planned_files(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 7).select(
        "id", F.when(F.col("id") % 3 > 0, "2020-01").when(F.col("id") % 9 == 0, "2020-02").alias("month"))
    out = sinks.write_folders(rows, str(tmp_path / "t"), ["month"], file_bytes=150_000)
    files = _files(out)
    assert len(files["month=2020-02"]) == 1 and 4 <= len(files["month=2020-01"]) <= 8
    back = spark.read.parquet(out)
    assert back.count() == 30_000 and back.where("month is null").count() == rows.where("month is null").count()
    sinks.write_folders(rows.limit(0), str(tmp_path / "e"), ["month"])


def test_carrier_zones_job_keeps_what_it_cannot_use(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    bill = shipping.carrier_bill_export_form(t.fedex).withColumn(
        "Pricing zone", F.when(F.col("`Pricing zone`") == "3", "zone 3").otherwise(F.col("`Pricing zone`")))
    margins = entry_mod.queries()["q15_margin_per_order"](spark, SF_SMALL)
    out = jobs.carrier_zones(bill, str(tmp_path / "zones"), margins)
    assert spark.read.parquet(out["rejected_zones"]).where("pricing_zone = 'zone 3'").count() > 0
    assert spark.read.parquet(out["orders_with_zones"]).count() > 0
    dates = [r[0] for r in spark.read.parquet(out["bill"]).select("date_invoice").collect()]
    assert len(dates) == bill.distinct().count()


@pytest.mark.parametrize("wanted", [(1,), (3, -1, 5000, 10**9, 0, -10**9), (-2, 2, 2)])
def test_rows_at_positions(spark, wanted):
    vals = [None, *range(200), *range(0, 200, 2), 7, 7]
    df = spark.createDataFrame([(v,) for v in vals], "v int").repartition(5)
    order = sorted(vals, key=lambda v: (v is not None, v or 0))
    want = {(p if p > 0 else len(order) + 1 + p) for p in wanted if p}
    got = {r.position: r.v for r in positions.rows_at(df, wanted, ["v"]).collect()}
    assert got == {p: order[p - 1] for p in want if 0 < p <= len(order)}
    assert positions.rows_at(df.limit(0), wanted, ["v"]).count() == 0


def test_windows_of_ten_years_and_many_of_them(spark, monkeypatch):
    from ordercraft import session
    days = [dt.datetime(2000, 1, 1) + dt.timedelta(hours=31 * i) for i in range(3000)]
    lines = spark.createDataFrame([(d,) for d in days], "transaction_date timestamp_ntz")
    spans = [(f"w{i}", dt.date(2000, 1, 1) + dt.timedelta(days=i * 5), dt.date(2000, 1, 1) + dt.timedelta(days=i * 5 + n))
             for i, n in enumerate([3650, 0, 1, 40, -1, 700] * 40)]
    windows = spark.createDataFrame(spans, "window_label string, start_day date, end_day date")

    def want(w):
        lo, hi = (dt.datetime(x.year, x.month, x.day) for x in w[1:])
        return sum(lo <= d <= hi for d in days)

    small = calendar.in_windows(lines, windows)
    monkeypatch.setattr(calendar, "bounded_side", lambda df, name: session.bounded_side(df, name, limit_bytes=1))
    large = calendar.in_windows(lines, windows)
    assert "broadcast" not in large._jdf.queryExecution().analyzed().toString().lower()
    for df in (small, large):
        got = {r.window_label: r["count"] for r in df.groupBy("window_label").count().collect()}
        assert got == {w[0]: want(w) for w in spans if want(w)}


def test_fiscal_quarters_end_in_september(spark):
    d = spark.createDataFrame([(1, dt.datetime(2019, 9, 30, 23), 5.0), (2, dt.datetime(2020, 10, 1), 7.0)],
                              "transaction_id long, transaction_date timestamp_ntz, order_total double")
    q = [tuple(r) for r in calendar.fiscal_buckets(d, "quarter").orderBy("period_end").collect()]
    assert [(str(r[1]), r[2], r[3], str(r[4]), r[6]) for r in q] == [
        ("2019-09-30", 2019, 4, "2019-06-30", 1), ("2019-12-31", 2020, 1, "2019-09-30", 0),
        ("2020-03-31", 2020, 2, "2019-12-31", 0), ("2020-06-30", 2020, 3, "2020-03-31", 0),
        ("2020-09-30", 2020, 4, "2020-06-30", 0), ("2020-12-31", 2021, 1, "2020-09-30", 1)]
    assert calendar.as_of(d) == "2020-10-01" and jobs.data_day(d.limit(0)) == dt.date.today().isoformat()
    assert [r.fiscal_year for r in calendar.fiscal_buckets(d, "year").orderBy("period_end").collect()] == [2019, 2020, 2021]


def test_jobs_are_stamped_with_the_data_day(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    out = jobs.week_review_report(t.sales, "1998-01-01", "1999-12-31", str(tmp_path / "wr"))
    assert f"as_of_{calendar.as_of(t.sales)}" in out["daily_summary"]


def test_large_orders_are_totalled_apart(spark):
    t = Tables(spark, SF_SMALL)
    log = t.ship_log.unionByName(t.ship_log.where("order_no % 11 = 0"))
    lines = enrich.prepare_lines(t.sales)
    cols = ["transaction_id", "line_seq", "margin_per_order", "income_order"]
    a = enrich.enrich_lines(lines, t.pricing, log, hot_orders=[]).selectExpr(*[f"cast({c} as double) {c}" for c in cols])
    b = enrich.enrich_lines(lines, t.pricing, log, hot_orders=[1]).selectExpr(*[f"cast({c} as double) {c}" for c in cols])
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("name", ["q05_enriched_lines", "q12_order_freight", "q15_margin_per_order"])
def test_lines_are_read_and_joined_once(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(entry_mod.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    tree = text.split("\n\n(1)")[0]
    assert tree.count("SortMergeJoin") == 2 and tree.count("Scan parquet") == 3 and tree.count("Exchange") == 4


def test_subtotal_levels_come_from_the_lowest(spark):
    s = Tables(spark, SF_SMALL).sales
    how = {"product_quantity": F.sum, "product_price": F.avg, "line_seq": F.count, "customer_email": F.count_distinct,
           "product_weight": F.stddev}
    keys = ["customer_state", "product_options"]
    plan = subtotals.subtotals(s, ["product_quantity"], keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")
    got = subtotals.subtotals(s, list(how), keys, aggregates=how)
    want = s.groupBy("customer_state").agg(*[f(c).alias(c) for c, f in how.items()])
    cols = ["customer_state", *how]
    top = got.where("product_options = '[Total]'").select(*[F.round(c, 6).alias(c) if c == "product_weight" else c for c in cols])
    want = want.select(*[F.round(c, 6).alias(c) if c == "product_weight" else c for c in cols])
    assert top.count() == want.count() and top.exceptAll(want).count() == 0


def test_long_differences_keep_missing_periods(spark):
    long = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("b", 2, 4), (None, 1, 2)], "k string, p int, v int")
    rows = {(r.k, r.p): r.v for r in subtotals.dense_periods(long, ["k"], "p").collect()}
    assert rows == {("a", 1): 5, ("a", 2): None, ("a", 3): 9, ("b", 1): None, ("b", 2): 4, ("b", 3): None,
                    (None, 1): 2, (None, 2): None, (None, 3): None}
    diff = {(r.k, r.p): (r.difference, r.difference_pct) for r in
            subtotals.period_differences(long, ["k"], "p", "v").collect()}
    assert diff[("a", 1)] == (None, None) and diff[("a", 2)] == (-5, -1.0) and diff[("b", 2)] == (4, None)


def test_too_many_pivot_columns_are_refused(spark):
    with pytest.raises(ValueError, match="long form"):
        subtotals.distinct_values(spark.range(50), "id", limit=49)


def test_feed_takes_late_lines_of_an_order(spark, tmp_path):
    from ordercraft.streaming.ship_log_feed import start_ship_log_feed
    lines = _lines(spark).withColumn("transaction_date", F.col("transaction_date"))
    log, inbox, ckpt = (str(tmp_path / x) for x in ("log", "inbox", "ckpt"))
    spark.createDataFrame([(1, 2.5)], "transaction_id long, actual_freight_expense double").write.parquet(log)

    def feed(rows, name):
        rows.write.parquet(f"{inbox}/{name}")
        q = start_ship_log_feed(spark, inbox, lines.schema, log, ckpt)
        q.awaitTermination(120)
        return ship_log.read_log(spark, log).where("product_name is not null").count()

    assert feed(lines.where("transaction_id < 4 and product_name <> 'p2'"), "a") == 4
    assert feed(lines.where("transaction_id < 5"), "b") == 9
    assert feed(lines.where("transaction_id < 5"), "c") == 9
