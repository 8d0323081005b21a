"""Every registered query against its SQL twin on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from check_queries import rows_of, type_differences
from filewright.workload.oracles import oracle_sql
from filewright.workload.registered import QUERIES


@pytest.fixture(scope="module")
def database(data):
    connection = duckdb.connect()
    for file in sorted(Path(data).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, database, name):
    frame = QUERIES[name](spark, data)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    found = database.execute(oracle_sql()[name])
    assert type_differences(frame, found.description) == []
    assert got == rows_of([column[0] for column in found.description], found.fetchall())
