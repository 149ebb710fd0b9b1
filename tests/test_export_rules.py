"""Exports as they come: shuffled headers, quoted line breaks, unusable rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordercraft import session
from ordercraft.operators import packaging, subtotals
from ordercraft.sources import csv_exports
from ordercraft.sources.tables import read_pricing, read_ship_log


def test_price_table_is_read_by_name(spark, tmp_path):
    p = tmp_path / "prices.csv"
    p.write_text('product_options,product_name,product_weight,product_price\nBlue,Bag,2.5,10.00\n')
    r = read_pricing(spark, str(p)).first()
    assert (r.product_name, r.product_options, float(r.product_price)) == ("Bag", "Blue", 10.0)


def test_ship_log_takes_either_key(spark, tmp_path):
    for i, head in enumerate(("Order #", "transaction_id")):
        p = tmp_path / f"log{i}.csv"
        p.write_text(f"{head},Actual Freight Expense\n7,1.50\n")
        assert read_ship_log(spark, str(p)).first().order_no == 7


def test_quoted_line_breaks_and_many_headers(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"f{i:03}.csv").write_text(f'a,extra_{i}\n"Big\nBag",{i}\n')
    d = csv_exports.read_csv_exports(spark, str(tmp_path), keep_source=False)
    rows = d.collect()
    assert len(rows) == 70 and {r.a for r in rows} == {"Big\nBag"} and len(d.columns) == 71


def test_pivots_follow_the_data(spark):
    d = spark.createDataFrame([(y, "s", "p", 1) for y in (1990, 1995, 2030)], "y int, s string, p string, v int")
    w = subtotals.subtotals_wide(d, "v", ["y", "s", "p"])
    assert set(w.columns) == {"s", "p", "1990", "1995", "2030"}
    top = subtotals.subtotals(d.withColumn("v", F.col("y")), "v", ["s", "p"], aggregates={"v": F.max})
    assert {r.v for r in top.collect()} == {2030}
    inv = spark.createDataFrame([("b", 1, "packaging", dt.date(2001, m, 28), float(m)) for m in range(1, 13)],
                                "packaging string, item_code int, type string, date date, inventory_count double")
    r = packaging.inventory_summary(inv).first()
    assert len(r) == 15 and r.used_last_month == 1.0


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


HEAD = "transaction_id,transaction_date,order_total,category_code,product_name,product_quantity\n"


def _scan(spark, folder):
    from pyspark.sql import types as T
    from ordercraft.schemas import MONEY
    kinds = {"order_total": MONEY, "product_quantity": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in HEAD.strip().split(",")])
    return csv_exports.scan_exports(spark, str(folder), schema)


def test_values_are_read_right_or_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n".join([
        "1,2020-05-01,$10.00,c,Bag,2.0", "2,2020-05-01,10.005,c,Bag,1", '3,2020-05-01,"1,234.50",c,Bag,two',
        "4,2020-05-01,1,c,Bag,1,more", "5.0,2020-05-01, ,c,Bag", "", "6,2020-05-01,-$3,c,\"a \"\"b\"\", c\",1"]) + "\n")
    found = _scan(spark, tmp_path)
    good = {r.transaction_id: (r.order_total, r.product_name, r.product_quantity) for r in found.lines.collect()}
    bad = {r.raw_line: (r.reject_reason, r.reject_fields, r.export_line) for r in found.rejects.collect()}
    assert {k: (None if v[0] is None else float(v[0]), *v[1:]) for k, v in good.items()} == {
        "1": (10.0, "Bag", 2), "5.0": (None, "Bag", None), "6": (-3.0, 'a "b", c', 1)}
    assert bad == {"2,2020-05-01,10.005,c,Bag,1": ("unreadable_value", "order_total", 2),
                   '3,2020-05-01,"1,234.50",c,Bag,two': ("unreadable_value", "product_quantity", 3),
                   "4,2020-05-01,1,c,Bag,1,more": ("surplus_fields", "", 4)}
    with pytest.raises(Exception, match="unreadable row"):
        csv_exports.read_csv_exports(spark, str(tmp_path), found.lines.select(*HEAD.strip().split(",")).schema).count()


def test_places_follow_the_files_over_many_blocks(spark, tmp_path):
    for k in range(3):
        rows = "".join(f"{k},2020-01-01,1,c{i},Bag,1\n" for i in range(900))
        (tmp_path / f"f{k}.csv").write_text(HEAD + rows + (f'{k},2020-01-01,1,c900,"Big\nBag",1\n' if k == 1 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = _scan(spark, tmp_path)
        rows = found.lines.orderBy("export_line").collect()
        blocks = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_block_start as b").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 3  # large files are cut into blocks
    assert [(r.transaction_id, r.category_code) for r in rows] == \
        [(str(k), f"c{i}") for k in range(3) for i in range(901 if k == 1 else 900)]
    assert len({r.export_line for r in rows}) == len(rows)


ORDERS = [  # order 2: a bad date; 3: one on its second line; 4: no date; 5: in part without id
    "1,2020-05-01 10:00:00,9,a,Bag,1", "1,,,,Cup,1", "1,,,b,Hat,1", "1,,,,Pen,1",
    "2,01.05.2020,9,a,Bag,1", "2,,,,Cup,1", "2,,,,Hat,1", "3,2020-05-01,9,a,Bag,1", "3,01.05.2020,,,Cup,1",
    "4,,9,a,Bag,1", "4,,,,Cup,1", "5,2020-05-01,9,a,Bag,1", ",,,,Cup,1", "x7,2020-05-01,9,a,Bag,1",
    "6,2017-12-31,9,a,Bag,1", "6,,,,Cup,1", "8,2020-05-01,9,a,Bag,1", "8,,,,Bag,1", "8,,,,Cup,two"]


@pytest.mark.parametrize("hot", [(), "all"])
def test_orders_are_reported_whole_or_not_at_all(spark, tmp_path, hot):
    from ordercraft.operators import clean
    (tmp_path / "a.csv").write_text(HEAD + "\n".join(ORDERS[:10]) + "\n")
    (tmp_path / "b.csv").write_text(HEAD + "\n".join(ORDERS[10:] + ORDERS[:4]) + "\n")
    done = clean.clean_exports(_scan(spark, tmp_path), hot_keys=hot)
    lines = sorted((r.transaction_id, r.export_line, r.category_code, r.product_name, r.export_copies)
                   for r in done.lines.collect())
    # both paths of the fill: blanks take the value before them in file order
    assert [x for x in lines if x[0] == 1] == [(1, 1, "a", "Bag", 2), (1, 2, "a", "Cup", 1), (1, 3, "b", "Hat", 2),
                                               (1, 4, "b", "Pen", 2), (1, 21, "b", "Cup", 1)]
    assert [x[0] for x in lines if x[0] != 1] == [5]
    why = sorted((r.raw_line, r.reject_reason) for r in done.rejects.collect())
    assert why == sorted([
        (ORDERS[4], "unreadable_date"), (ORDERS[5], "order_incomplete"), (ORDERS[6], "order_incomplete"),
        (ORDERS[7], "order_incomplete"), (ORDERS[8], "unreadable_date"), (ORDERS[9], "no_date"),
        (ORDERS[10], "no_date"), (ORDERS[12], "no_order_id"), (ORDERS[13], "no_order_id"),
        (ORDERS[16], "order_incomplete"), (ORDERS[17], "order_incomplete"), (ORDERS[18], "unreadable_value")])
    account = {r.outcome: r.n_rows for r in done.account().collect()}
    assert sum(account.values()) == len(ORDERS) + 4 and account["before_start"] == 2
    by_order = done.account(["transaction_id"]).collect()
    kinds = {}
    for r in by_order:
        kinds.setdefault(r.transaction_id, set()).add(r.outcome in ("reported", "before_start"))
    assert all(len(v) == 1 for k, v in kinds.items() if k is not None)


def test_command_line_without_line_numbers(spark, tmp_path):
    from ordercraft.__main__ import main
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "\n".join(ORDERS) + "\n")
    out = main(["week-review", "--exports", str(tmp_path / "in" / "*.csv"), "--start", "2018-01-01",
                "--end", "2020-12-31", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(out["daily_details"]).count() == 1
    account = spark.read.option("header", True).csv(str(tmp_path / "out" / "rejects" / "account")).collect()
    assert sum(int(r.n_rows) for r in account) == len(ORDERS)
    rejected = spark.read.option("header", True).csv(str(tmp_path / "out" / "rejects" / "rows"))
    assert rejected.where("reject_reason = 'no_date'").count() == 2


def test_scratch_tables_go_after_a_job_and_stay_after_a_failure(spark):
    import os

    from ordercraft.session import materialize, scratch_scope

    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    kept = folder(materialize(spark.range(3), "kept"))
    with scratch_scope(spark):
        gone = folder(materialize(spark.range(3), "gone"))
        assert os.path.exists(gone)
    assert os.path.exists(kept) and not os.path.exists(gone)
    with pytest.raises(ValueError), scratch_scope(spark):
        left = folder(materialize(spark.range(3), "left"))
        raise ValueError
    assert os.path.exists(left)
