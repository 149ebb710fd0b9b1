"""Sources, sinks and the streaming ship-log feed."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ordercraft.operators.shipping import LOG_UPDATE_COLUMNS
from ordercraft.sources import sinks
from ordercraft.sources.fixtures import Tables
from ordercraft.streaming.ship_log_feed import start_ship_log_feed


def test_sinks_write_and_read_back(spark, tmp_path):
    s = Tables(spark, SF_SMALL).sales
    p = sinks.write_order_lines(s, str(tmp_path / "lines"))
    back = spark.read.parquet(p)
    assert back.count() == s.count() and "order_month" in back.columns
    # partition pruning on the month column
    assert back.filter(F.col("order_month") == "1999-01").count() == \
        s.filter(F.date_format("transaction_date", "yyyy-MM") == "1999-01").count()
    v = sinks.write_versioned(s.limit(5), str(tmp_path), "pricing", version="1")
    assert v.endswith("pricing/version=1") and spark.read.parquet(v).count() == 5
    c = sinks.write_csv(s.select("transaction_id", "product_name"), str(tmp_path / "todo"))
    assert spark.read.option("header", True).csv(c).columns == ["transaction_id", "product_name"]
    named = sinks.write_named_tables({"Daily Summary": s.limit(1), "Weekly": s.limit(2)},
                                     str(tmp_path / "book"))
    assert spark.read.parquet(named["Weekly"]).count() == 2
    sp = sinks.write_split(s, str(tmp_path / "split"), "customer_state", "product_options",
                           keep=["NATION_1"], as_of="2001-01-01")
    assert spark.read.parquet(sp).select("customer_state").distinct().count() == 1
    sinks.append_rows(s.limit(3), str(tmp_path / "log"))
    sinks.append_rows(s.limit(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_ship_log_feed_appends_only_new_orders(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    lines = t.sales.select(*LOG_UPDATE_COLUMNS)
    incoming = tmp_path / "incoming"
    log = str(tmp_path / "ship_log")
    # the log already knows every order id divisible by 3
    lines.filter(F.col("transaction_id") % 3 == 0).select("transaction_id").distinct() \
        .write.parquet(log)
    lines.filter(F.col("transaction_id") < 2000).write.parquet(str(incoming / "b1"))
    q = start_ship_log_feed(spark, str(incoming), lines.schema, log, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.option("mergeSchema", True).parquet(log)
    new = got.filter(F.col("product_name").isNotNull())
    expect = lines.filter((F.col("transaction_id") < 2000) & (F.col("transaction_id") % 3 != 0)) \
        .dropDuplicates()
    assert new.select(*LOG_UPDATE_COLUMNS).exceptAll(expect).count() == 0
    assert expect.exceptAll(new.select(*LOG_UPDATE_COLUMNS)).count() == 0
    # a second run over an overlapping drop adds only the orders not yet logged
    lines.filter(F.col("transaction_id") < 4000).write.parquet(str(incoming / "b2"))
    q = start_ship_log_feed(spark, str(incoming), lines.schema, log, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    per_id = spark.read.option("mergeSchema", True).parquet(log).filter(F.col("product_name").isNotNull()) \
        .groupBy("transaction_id").agg(F.countDistinct("transaction_date").alias("n"))
    assert per_id.filter("n > 1").count() == 0
    dup = spark.read.option("mergeSchema", True).parquet(log).filter(F.col("product_name").isNotNull())
    assert dup.count() == dup.dropDuplicates().count()


def test_run_stamp_format(spark):
    from ordercraft.functions.dates import run_stamp
    txt = rows(spark.range(1).select(run_stamp().alias("s")))[0][0]
    dt.datetime.strptime(txt, "%m/%d/%Y - %I:%M %p")


def test_margin_report_job(spark, tmp_path):
    from ordercraft.plans import jobs
    t = Tables(spark, SF_SMALL)
    out = jobs.margin_report(t.sales, t.pricing, t.ship_log, str(tmp_path / "report"),
                             since="2000-01-01", freight_since="2000-01-01",
                             cutover="1998-01-01", as_of="2001-01-01")
    import __spark_entry__ as entry_mod
    margins = spark.read.parquet(out["Margin per Order"])
    assert margins.count() == entry_mod.queries()["q15_margin_per_order"](spark, SF_SMALL).count()
    assert spark.read.parquet(out["Summary"]).count() == 4
    assert spark.read.parquet(out["missing_freight"]).count() == \
        entry_mod.queries()["q06_missing_freight"](spark, SF_SMALL).count()


def test_week_review_and_ship_log_jobs(spark, tmp_path):
    from ordercraft.plans import jobs
    t = Tables(spark, SF_SMALL)
    out = jobs.week_review_report(t.sales, "1998-01-01", "1999-12-31", str(tmp_path / "wr"),
                                  as_of="2001-01-01")
    assert spark.read.parquet(out["daily_summary"]).count() == 8
    log = str(tmp_path / "log")
    t.ship_log.withColumnRenamed("order_no", "transaction_id").write.parquet(log)
    new = jobs.ship_log_update(t.sales, t.ship_log, log)
    total = spark.read.option("mergeSchema", True).parquet(log).count()
    assert total == t.ship_log.count() + new.count()


def test_side_table_readers(spark, tmp_path):
    from ordercraft.sources.tables import read_pricing, read_ship_log
    (tmp_path / "log.csv").write_text("Order #,Actual Freight Expense,Note\n7,12.5,x\n8,,y\n")
    log = read_ship_log(spark, str(tmp_path / "log.csv"))
    assert log.columns == ["order_no", "actual_freight_expense"]
    assert sorted(rows(log, "order_no")) == [(7,), (8,)]
    assert "Note" in read_ship_log(spark, str(tmp_path / "log.csv"), all_columns=True).columns
    t = Tables(spark, SF_SMALL)
    p = str(tmp_path / "pricing")
    t.pricing.write.parquet(p)
    assert read_pricing(spark, p).count() == t.pricing.count()


def test_packaging_month_end_job(spark, tmp_path):
    from ordercraft.plans import jobs
    import datetime as dt
    ends = [dt.date(2001, 9, 30), dt.date(2001, 10, 31), dt.date(2001, 11, 30)]
    t = Tables(spark, SF_SMALL)
    out = jobs.packaging_month_end(t.inventory, t.production, ends, 6, 1999,
                                   str(tmp_path / "pack"), as_of="2001-12-01")
    assert set(out) == {"pack_count", "retail_count", "production", "production_retail"}
    assert spark.read.parquet(out["production"]).count() > 0


def test_command_line_margin_report_from_csv_exports(spark, tmp_path):
    from ordercraft.__main__ import main
    from ordercraft.sources.csv_exports import write_csv_export
    import __spark_entry__ as entry_mod
    t = Tables(spark, SF_SMALL)
    write_csv_export(t.raw_sales, str(tmp_path / "exports" / "pull1"))
    t.pricing.write.parquet(str(tmp_path / "pricing"))
    (t.ship_log.withColumnRenamed("order_no", "Order #")
      .withColumnRenamed("actual_freight_expense", "Actual Freight Expense")
      .coalesce(1).write.option("header", True).csv(str(tmp_path / "log_csv")))
    log_file = next((tmp_path / "log_csv").glob("*.csv"))
    out = main(["margin-report", "--exports", str(tmp_path / "exports" / "*" / "*.csv"),
                "--pricing", str(tmp_path / "pricing"), "--ship-log", str(log_file),
                "--out", str(tmp_path / "out"), "--start", "1995-01-01",
                "--cutover", "1998-01-01", "--since", "2000-01-01"])
    margins = spark.read.parquet(out["Margin per Order"])
    expected = entry_mod.queries()["q15_margin_per_order"](spark, SF_SMALL)
    assert margins.count() == expected.count()
    got = margins.selectExpr("sum(cast(net_margin as double))").first()[0]
    want = expected.selectExpr("sum(net_margin)").first()[0]
    assert abs(got - want) < 1e-6


def test_repeat_customers_report_job(spark, tmp_path):
    from ordercraft.plans import jobs
    t = Tables(spark, SF_SMALL)
    out = jobs.repeat_customers_report(t.sales, str(tmp_path / "rc"), cutover="1998-01-01",
                                       as_of="2001-01-01")
    assert set(out) == {"email", "cust_post", "ship_post", "ship_name"}
    assert spark.read.parquet(out["email"]).count() > 0
