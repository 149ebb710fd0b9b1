"""Summarize the physical plan of every registered analysis as a Markdown table.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md

Counts come from the plan Spark would start with (``explain("formatted")``,
before AQE re-plans at run time): shuffles (hash / range exchanges),
broadcast-hash and sort-merge joins, windows, expands (grouping sets,
distinct aggregates), scans, and whether a filter was pushed into a Parquet
scan. Shuffles, joins and scans are counted twice: as planned, and with automatic
broadcasts off, which is the plan for tables too large for them. The text
operators are left out: they are chains of jobs over written tables.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordercraft.plans import QUERIES  # noqa: E402
from ordercraft.session import get_session  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def nodes(text: str, op: str) -> int:
    return len(re.findall(rf"^\(\d+\) {op}\b", text, flags=re.M))


def joins(text: str) -> str:
    shuffles = len(re.findall(r"Arguments: (hash|range)partitioning\(", text))
    return " / ".join(str(x) for x in (shuffles, nodes(text, "BroadcastHashJoin"),
                                       nodes(text, "SortMergeJoin"), nodes(text, "Scan")))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans of the registered analyses ({os.path.basename(sf_dir)})\n")
    print("Generated by `scripts/plan_report.py`: the plan Spark starts with (AQE may still turn a "
          "sort-merge join into a broadcast join at run time). Inputs are the materialized fixture "
          "views, so the view-building joins are not part of these plans.\n")
    print("`shuffles / broadcast joins / sort-merge joins / scans`, as planned and without automatic broadcasts.\n")
    print("| analysis | as planned | broadcasts off | windows | expands | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- |")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, fn in QUERIES.items():
        text = plan_text(fn(spark, sf_dir))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        off = plan_text(fn(spark, sf_dir))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        pushed = "yes" if re.search(r"PushedFilters: \[[^\]]*(GreaterThan|LessThan|EqualTo|In\()",
                                    text) else "-"
        row = [name, joins(text), joins(off), nodes(text, "Window"), nodes(text, "Expand"), pushed]
        print("| " + " | ".join(str(x) for x in row) + " |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
