"""Each registered query against its SQL on DuckDB over the smallest tables; the others must give rows."""

import math
import os

import pytest

import __spark_entry__ as entry
from colloquy.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value if value is None or isinstance(value, (bool, str)) else float(value) if isinstance(value, int) or hasattr(value, "is_signed") else str(value)


def rows_of(rows, columns, of):
    return sorted((tuple(plain(of(r, c)) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    found = sql.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    want = rows_of(found.fetchall(), columns, lambda r, c: r[found.columns.index(c)])
    assert rows_of(got, columns, lambda r, c: r[c]) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
