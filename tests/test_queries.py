"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidebar import oracle, queries

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    found = db.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["bootstrap_ci", "bootstrap_diff"])
def test_the_others_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
