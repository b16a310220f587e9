"""Every query with SQL against DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: `benchmark` holds no near copies, and every order has its customer; tests over other tables cover these.
EMPTY = {"anti_missing", "duplicate_clusters", "lcs_verified_pairs", "lsh_candidates"}


def rows(frame):
    cols = sorted(frame.columns)
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)
    return cols, sorted(tuple(map(show, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in EMPTY
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
