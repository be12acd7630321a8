"""Every registered query runs; those with SQL agree with DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.config import Config
from tidemark.plans import queries as market

QUERIES, SQL = market.queries(), market.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert rows
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_config_from_environment():
    assert Config.from_env(env={"TIDEMARK_STALE_MS": "50", "OTHER": "1"}) == Config(stale_ms=50)
