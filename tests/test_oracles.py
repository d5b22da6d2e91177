"""Every registered query against its SQL on the smallest supplied tables."""
import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert canonical(result.columns, [tuple(r) for r in result.collect()]) == canonical(columns, cursor.fetchall())


def without_sql():
    """Queries of the training-text operators that SQL cannot say; brute force stands in for it in their own tests."""
    return [n for n in QUERIES if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit() and n not in ORACLE)]


def test_every_query_is_registered_once():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"linkage_e2e_trained"} | {n for n in without_sql() if n in QUERIES}
