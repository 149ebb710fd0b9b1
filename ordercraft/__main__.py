"""Command line: run the report jobs on exported files.

    python -m ordercraft margin-report --exports 'exports/*.csv' --pricing pricing.parquet \
        --ship-log ship_log.csv --out out/ [--since 2020-03-23] [--start 2018-01-01]
    python -m ordercraft week-review --exports 'exports/*.csv' --start 2020-01-01 \
        --end 2020-12-31 --out out/
    python -m ordercraft ship-log-update --exports 'exports/*.csv' --ship-log log/ \
        [--since 2018-01-01]
    python -m ordercraft repeat-customers --exports 'exports/*.csv' --out out/ [--min-year 2012]
    python -m ordercraft price-refresh --exports 'exports/*.csv' --prices prices/ [--pricing pricing.parquet]
    python -m ordercraft ship-log-printout --exports 'exports/*.csv' --pricing pricing.parquet \
        --ship-log ship_log.csv --out out/
    python -m ordercraft carrier-zones --bill 'bills/*.csv' --out out/ [--margins margins.parquet]
    python -m ordercraft packaging --inventory inv.parquet --production prod.parquet \
        --month 9 --year 2019 --months 2019-07-31,2019-08-31,2019-09-30 --out out/

Order exports are CSV files stacked by column name and cleaned (fill, dedupe,
null fill, before/after label) before the report runs. Spark settings come
from the launcher (``spark-submit --conf ...``); nothing here picks a master.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from .operators import clean
from .plans import jobs
from .schemas import CARRIER_BILL_CSV, ORDER_LINES_CSV
from .session import get_session, scratch_scope
from .sources.csv_exports import PLACE, REASON, SOURCE, scan_exports
from .sources.tables import read_pricing, read_ship_log, read_table


def _clean_exports(spark, pattern: str, start: str, cutover: str, rejects_dir: str):
    """Cleaned lines, written once, with ``line_seq``: the export's own line number
    (which keeps equal lines of an order apart) or the place in the files. Rows that cannot be used go to ``rejects_dir``, one folder per reason, with
    their file, place and raw line, and the number of rows per outcome beside them."""
    found = scan_exports(spark, pattern, ORDER_LINES_CSV)
    done = clean.clean_exports(found, start=start, cutover=cutover)
    lines = jobs.materialize(done.lines, "clean_lines")
    done.rejects.write.mode("overwrite").partitionBy(REASON).option("header", True).csv(f"{rejects_dir}/rows")
    clean.Cleaned(lines, done.rejects, done.early).account().coalesce(1) \
        .write.mode("overwrite").option("header", True).csv(f"{rejects_dir}/account")
    lines = lines.drop(clean.COPIES)
    if "line_seq" in found.columns:
        return lines.drop(PLACE).withColumn("line_seq", lines["line_seq"].try_cast("long"))
    return lines.withColumnRenamed(PLACE, "line_seq")


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="ordercraft")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("margin-report", "week-review", "ship-log-update", "repeat-customers", "price-refresh",
                 "ship-log-printout"):
        p = sub.add_parser(name)
        p.add_argument("--exports", required=True, help="glob of order-export CSV files")
        p.add_argument("--start", default=clean.DEFAULT_START, help="keep orders from this date")
        p.add_argument("--cutover", default=clean.DEFAULT_CUTOVER)
        p.add_argument("--rejects", default=None,
                       help="folder for unusable rows (default: rejects under --out, or beside the log)")
    mr = sub.choices["margin-report"]
    mr.add_argument("--pricing", required=True)
    mr.add_argument("--ship-log", required=True)
    mr.add_argument("--out", required=True)
    mr.add_argument("--since", default="2020-03-23")
    mr.add_argument("--freight-since", default="2020-01-01")
    wr = sub.choices["week-review"]
    wr.add_argument("--end", required=True)
    wr.add_argument("--out", required=True)
    wr.add_argument("--review-start", default=None)
    rc = sub.choices["repeat-customers"]
    rc.add_argument("--out", required=True)
    rc.add_argument("--min-year", type=int, default=None)
    su = sub.choices["ship-log-update"]
    su.add_argument("--ship-log", required=True, help="ship-log table to append to (Parquet)")
    pr = sub.choices["price-refresh"]
    pr.add_argument("--prices", required=True, help="folder of the published price tables")
    pr.add_argument("--pricing", default=None, help="price table to start from (default: the one published last)")
    po = sub.choices["ship-log-printout"]
    for arg in ("--pricing", "--ship-log", "--out"):
        po.add_argument(arg, required=True)
    cz = sub.add_parser("carrier-zones")
    cz.add_argument("--bill", required=True, help="glob of carrier-bill CSV files")
    cz.add_argument("--margins", default=None, help="margin-per-order table (Parquet)")
    cz.add_argument("--out", required=True)
    pk = sub.add_parser("packaging")
    pk.add_argument("--inventory", required=True)
    pk.add_argument("--production", required=True)
    pk.add_argument("--month", type=int, required=True)
    pk.add_argument("--year", type=int, required=True)
    pk.add_argument("--months", default=None,
                    help="comma-separated month ends, ascending (default: all in the counts)")
    pk.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = get_session()
    with scratch_scope(spark):  # a job's results are written when it returns
        return _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.job == "packaging":
        months = [dt.date.fromisoformat(m) for m in args.months.split(",")] if args.months else None
        return jobs.packaging_month_end(read_table(spark, args.inventory),
                                        read_table(spark, args.production), months, args.month,
                                        args.year, args.out)
    if args.job == "carrier-zones":
        found = scan_exports(spark, args.bill, CARRIER_BILL_CSV)
        found.rejects.write.mode("overwrite").option("header", True).csv(f"{args.out.rstrip('/')}/rejects/rows")
        return jobs.carrier_zones(found.lines.drop(SOURCE, PLACE), args.out,
                                  spark.read.parquet(args.margins) if args.margins else None)
    base = {"ship-log-update": lambda: args.ship_log.rstrip("/") + "_",
            "price-refresh": lambda: args.prices.rstrip("/") + "/"}.get(args.job, lambda: args.out.rstrip("/") + "/")()
    lines = _clean_exports(spark, args.exports, args.start, args.cutover,
                           args.rejects or f"{base}rejects")
    if args.job == "margin-report":
        return jobs.margin_report(lines, read_pricing(spark, args.pricing),
                                  read_ship_log(spark, args.ship_log), args.out,
                                  since=args.since, freight_since=args.freight_since,
                                  cutover=args.cutover)
    if args.job == "repeat-customers":
        return jobs.repeat_customers_report(lines, args.out, min_year=args.min_year,
                                            cutover=args.cutover)
    if args.job == "week-review":
        return jobs.week_review_report(lines, args.review_start or args.start, args.end, args.out)
    if args.job == "price-refresh":
        return jobs.price_table_refresh(lines, args.prices, read_pricing(spark, args.pricing) if args.pricing else None)
    if args.job == "ship-log-printout":
        return {"to_add": jobs.ship_log_printout(lines, read_pricing(spark, args.pricing),
                                                 read_ship_log(spark, args.ship_log), args.out, args.start)}
    new = jobs.ship_log_update(lines, None, args.ship_log)
    return {"appended_to": args.ship_log, "rows": new.count()}


if __name__ == "__main__":
    print(json.dumps(main(), default=str))
