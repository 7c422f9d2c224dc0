"""Every query that has SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from plexgraph.plans import star_queries, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = star_queries.QUERIES | text_queries.QUERIES
SQL = star_queries.SQL | text_queries.SQL


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    listed = want.fetchall()
    order = [want.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in rows) == sorted(repr([r[i] for i in order]) for r in listed)


def test_pages_are_read_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = QUERIES["page_features"](spark, SF)
    assert found.count() == pages.count() and len(found.columns) == 8
    seen = {r.file_path for r in QUERIES["page_entities"](spark, SF).select("file_path").distinct().collect()}
    assert seen == {str(r.page_id) for r in pages.select("page_id").collect()}
