"""Every registered query against its SQL on the smallest tables; queries without SQL must run with a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def text(v) -> str:
    if isinstance(v, (list, tuple)) or v is None:
        return str(v)
    if pd.isna(v):
        return "None"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return str(v)


def rows(df):
    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_key_ranges_of_all_tables(spark, small):
    ranges = QUERIES["agg_pk_range_all"](spark, small).toPandas()
    assert set(ranges.table_name) == {"messages", "public.episodes", "public.checkpoints", "agent.facts"}
    assert ranges.pk_lo.notna().all() and ranges.pk_hi.notna().all()
    part = QUERIES["agg_pk_range"](spark, small).toPandas()
    both = part.merge(ranges, on=["segment", "table_name"])
    assert len(both) == len(part) and (both.pk_lo_x == both.pk_lo_y.astype(int)).all() and (both.pk_hi_x == both.pk_hi_y.astype(int)).all()
