"""Every query against its SQL in DuckDB, on the smallest data set."""

import datetime
import math
import os

import pytest

from wattline.plans.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "events"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rel = db.sql(ORACLES[name])
    columns = list(rel.columns)
    assert sorted(columns) == sorted(df.columns)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    assert {c: kinds[str(t)] for c, t in zip(columns, rel.types)} == dict(df.dtypes)
    mine = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rel.fetchall())
    assert mine == theirs
