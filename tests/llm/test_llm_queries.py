"""Registered queries with SQL against that SQL, the rest for their columns, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from check_queries import rows_of, type_differences
from filewright.llm.registered import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_suffixes": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_extraction": {"page_id", "url", "text", "n_chars"},
    "op10_simhash": {"doc_id", "fingerprint", "component_id"},
    "op11_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    connection = duckdb.connect()
    for file in sorted(Path(data).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, data)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    found = connection.execute(ORACLE_SQL[name])
    assert type_differences(frame, found.description) == []
    assert got == rows_of([column[0] for column in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert COLUMNS[name] <= set(frame.columns)
    table = "pages" if name == "op9_extraction" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    assert frame.select(key).distinct().count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_every_query_is_covered():
    assert set(QUERIES) == set(COLUMNS) | set(ORACLE_SQL)
