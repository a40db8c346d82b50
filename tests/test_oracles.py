"""Every query with a SQL counterpart against DuckDB on the same files; the others must return rows."""

from __future__ import annotations

import math

import duckdb
import pandas
import pytest

import __spark_entry__ as entry_point
from telewarden.sources.readers import TABLES

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pandas.NA or v != v:
        return (0, "")
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, str):
        return (2, v)
    return (1, float(v) if not isinstance(v, (list, tuple)) else math.nan)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, folder, name):
    ours = entry_point.queries()[name](spark, folder).toPandas()
    theirs = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(ORACLES)))
def test_returns_rows(spark, folder, name):
    assert entry_point.queries()[name](spark, folder).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())
