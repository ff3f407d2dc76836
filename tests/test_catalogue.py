"""Every query against its SQL in DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from leadloom import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(([canonical(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    rows = found.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert rows_of(found.columns, rows) == rows_of(columns, wanted.fetchall())
