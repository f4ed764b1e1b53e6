"""Every query of the catalogue against its DuckDB oracle."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from fieldspar.plans import catalogue, catalogue_reports  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x: object) -> str:
        if x is None or x is pd.NA or x != x:
            return "NULL"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        assert df.columns and df.count() > 0
        return
    expected = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.toPandas()) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
