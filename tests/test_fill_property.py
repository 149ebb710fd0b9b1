"""Forward fill against a plain-Python statement of its semantics on random
inputs, for the window path and the chunked (skew) path."""

import datetime as dt

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from conftest import rows
from ordercraft.operators.fill import forward_fill

DAYS = [None, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3)]

row = st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from(DAYS),
                st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 10, 20]))


def python_fill(data):
    """rows (key, date, x, y, seq): sort a key's rows by date (blank last) then
    seq, carry the last non-blank x and y; rows without a key stay as they are."""
    out = []
    groups = {}
    for r in data:
        if r[0] is None:
            out.append(r)
        else:
            groups.setdefault(r[0], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[4]))
        last = {1: None, 2: None, 3: None}
        for r in rs:
            vals = list(r)
            for i in (1, 2, 3):
                if vals[i] is None:
                    vals[i] = last[i]
                else:
                    last[i] = vals[i]
            out.append(tuple(vals))
    return sorted(out, key=str)


@settings(max_examples=12, deadline=None, derandomize=True, database=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=25), st.sampled_from([(), "all"]),
       st.integers(min_value=1, max_value=4))
def test_fill_matches_python(spark, data, hot, chunk):
    data = [(k, d, x, y, i) for i, (k, d, x, y) in enumerate(data)]
    df = spark.createDataFrame(data, "k long, d timestamp_ntz, x string, y int, seq long")
    out = forward_fill(df, "k", "d", ["seq"], ["d", "x", "y"], hot_keys=hot, chunk_rows=chunk)
    assert sorted(rows(out, "k", "d", "x", "y", "seq"), key=str) == python_fill(data)
