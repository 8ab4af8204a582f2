"""Every query with SQL gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

from sheaf import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(frame):
    def text(v):
        if v is None or v != v:
            return ""
        if hasattr(v, "strftime"):
            return v.strftime("%Y-%m-%d")
        return v if isinstance(v, str) else f"{float(v):.4f}"

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want[list(got.columns)])
