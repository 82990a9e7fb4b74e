"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from hearthlog.plans import catalogue, ingest, parts

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {**catalogue.QUERIES, **ingest.QUERIES, **parts.QUERIES}, {**catalogue.SQL, **ingest.SQL, **parts.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple("∅" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        expected = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
