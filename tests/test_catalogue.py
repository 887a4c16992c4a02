"""Every catalogue query against the SQL beside it, on the smallest tables."""

import os

import duckdb
import pytest

from framequery.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    answer = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(answer.fetchall(), columns)


def test_entry(spark):
    rows = catalogue.entry(spark, SF).collect()
    assert rows and all(r["reasons"][0].startswith("Milvus distance") for r in rows)
