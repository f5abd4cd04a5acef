"""Each query against its SQL, and those without SQL for rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lectern.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime") or df[c].map(lambda x: hasattr(x, "isoformat")).any():
            df[c] = df[c].astype(str).str[:10]
        df[c] = df[c].astype(object).where(df[c].notna(), None)
        df[c] = df[c].map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = tables.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
