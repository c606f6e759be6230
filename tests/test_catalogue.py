"""Every registered analytics query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tidewater.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(catalogue.queries()), dict(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "fiu" else df[c].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = normal(QUERIES[name](spark, SF).toPandas()), normal(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=1e-6, atol=1e-6, equal_nan=True, err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name,window,stride", [("rollhurst", 252, 1), ("rollcoherence", 64, 1), ("bettiseries", 40, 20)])
def test_rolling_kernels_cover_whole_series(spark, name, window, stride):
    from tidewater.plans.views import Views

    v = Views(spark, SF)
    days = v.both.selectExpr("'F-O' AS s", "d") if name == "rollcoherence" else v.ret.select("s", "d")
    want = days.toPandas().sort_values(["s", "d"]).groupby("s")["d"].apply(list).to_dict()
    got = QUERIES[name](spark, SF).toPandas().sort_values(["s", "d"])
    assert got.groupby("s")["d"].apply(list).to_dict() == want
    for _, one in got.groupby("s"):
        value = one["value"].to_numpy(float)
        assert np.flatnonzero(np.isfinite(value)).tolist() == list(range(window - 1, len(value), stride))


def test_names_need_no_session():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150
