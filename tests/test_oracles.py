"""Every query with a DuckDB text gives the rows that DuckDB gives."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from forgeline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    mine = ordered(df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = ordered(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLE_SQL[name]})").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"rf_metrics", "gbt_confusion"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
