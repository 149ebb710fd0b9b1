"""Every registered analysis against its DuckDB oracle (sf0.001), and the
flagship entry point."""

import os
import sys

import duckdb
import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))
from oracle_check import TABLES, _rows, _type_diffs  # noqa: E402

import __spark_entry__ as entry_mod  # noqa: E402
from ordercraft import plans  # noqa: E402

# all analyses of the library, and those text operators that SQL can express
# (tests/llm holds the others against brute force)
NAMES = sorted(set(plans.QUERIES) | set(entry_mod.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    missing = set(plans.QUERIES) - set(entry_mod.oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert not _type_diffs(df, res)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "net_margin" in df.columns
