"""Every query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalogue
from ledgerloom.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and v.dtype.kind in "if" else str(v)


def rows(frame):
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) & set(catalogue.ORACLE)))
def test_query_equals_oracle(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
