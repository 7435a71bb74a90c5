"""Every query against the same in DuckDB, value by value."""

import duckdb
import pytest

from driftloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    relation = duck.sql(registry.ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=str)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
