import os

import duckdb
import pytest

from codequarry.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in queries.ORACLE:
        for table in os.listdir(DATA):
            duckdb.sql(f"CREATE OR REPLACE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
        assert sorted(tuple(r) for r in rows) == sorted(duckdb.sql(queries.ORACLE[name]).fetchall())
