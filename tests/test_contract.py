"""The driver contract: entry, queries and their DuckDB oracle agree."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.parity import TABLES, rows_of


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["step_index", "step", "reached", "rate_prev", "rate_send"]
    assert [r.step for r in rows] == ["view", "click", "signup", "purchase"]


def test_every_oracle_names_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_cols, d_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
