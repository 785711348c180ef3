"""Registered queries on texts whose letters ASCII doesn't hold, against their SQL."""

import pytest

from colloquy.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, tmp_path, name, documents, turns):
    """The rows of a query and of its SQL over these documents (doc_id, text) and turns (conv_id, turn, role, text)."""
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df, found = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.ORACLES[name])
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str), sorted((tuple(r[found.columns.index(c)] for c in sorted(df.columns)) for r in found.fetchall()), key=str)


def test_kept_texts_without_an_ascii_letter(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "kept_texts", [(1, "a")], [(50, 1, "user", "Una las de ñ."), (50, 2, "assistant", "ja"), (100, 1, "user", "ñ. é"), (150, 1, "user", "Una las de ñ1")])
    assert got == want and len(got) == 3


def test_path_fusion_searches_for_the_words_as_documents_have_them(spark, tmp_path):
    documents = [(n, text) for n, text in enumerate(["eins ßlichbe wort", "sslichbe wort", "STRASSE hier", "straße dort", *[f"wort{k} anderes" for k in range(200)]])]
    turns = [(50, 1, "user", "Die ßlichbe Strasse"), (50, 2, "assistant", "ja"), (100, 1, "user", "STRASSE dort"), (150, 1, "user", "straße dort")]
    got, want = against_sql(spark, tmp_path, "path_fusion", documents, turns)
    assert got == want and len(got) == 9
