"""Queries of the subpackage that have SQL, against DuckDB."""

import duckdb
import pytest

from leadloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    wanted = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in wanted.description)
    at = [[d[0] for d in wanted.description].index(c) for c in columns]
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == columns
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted((tuple(r[k] for k in at) for r in wanted.fetchall()), key=str)
