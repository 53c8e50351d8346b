import os

import duckdb
import pytest

from codequarry.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_like_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in registry.ORACLE:
        result = oracle.sql(registry.ORACLE[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
