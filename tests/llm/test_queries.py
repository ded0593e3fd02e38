"""Registered queries: names, and those that SQL can express against SQL."""

import os

import pytest

from wattline.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and ORACLES.keys() <= QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, FOLDER)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(map(tuple, rel.fetchall()))
