"""The queries of the training-data operators against their SQL on DuckDB."""

import os

import pytest

from colloquy.llm import registry

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    df = registry.QUERIES[name](spark, sf_dir)
    found = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=str)
