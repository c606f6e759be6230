"""Registered queries of this subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from tidewater.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
