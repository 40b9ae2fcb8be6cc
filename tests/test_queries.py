"""Every query with SQL equals what DuckDB gives; the others hold their own rules."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

PLANS, SQL = {}, {}
for plan in entry.PLANS:
    PLANS |= plan.QUERIES
    SQL |= plan.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
            continue
        try:
            df[c] = pd.to_numeric(df[c]).astype(float).round(4) + 0.0
        except (ValueError, TypeError):
            pass
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    pd.testing.assert_frame_equal(plain(PLANS[name](spark, sf).toPandas()), plain(duck.execute(SQL[name]).df()))


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, sf, name):
    assert PLANS[name](spark, sf).columns
