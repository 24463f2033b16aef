"""Queries with SQL against DuckDB, and the columns of the others, on the smallest tables."""

import duckdb
import pytest

from sparklode.llm.queries import oracle_sql, queries

COLUMNS = {
    "op3": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4": "query_id rank vec_id score",
    "op6": "doc_id n_bytes n_removed n_spans kept_sha256 kept_text",
    "op7": "page_id url text n_chars",
    "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12": "page_id host path rule verdict by_tokens",
    "op13": "vec_id code error label_error codebooks_sha256",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries()))
def test_rows_and_columns(name, spark, data):
    found = queries()[name](spark, data)
    if (c := COLUMNS.get(name.split("_")[0])) is not None:
        assert found.columns == c.split()
    if not name.startswith(("op4", "op7", "op11", "op12", "op13")):
        assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
