"""Every query of the race engine against its SQL on an independent engine."""

import glob
import os

import duckdb
import pytest

from hexalane.queries import ORACLES, QUERIES


def plain(frame):
    def one(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.6f}"
        return str(v)[:10] if type(v).__name__ in ("date", "Timestamp") and str(v)[10:] in ("", " 00:00:00") else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        target = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{target}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).columns
